"""contentlens.functions."""
