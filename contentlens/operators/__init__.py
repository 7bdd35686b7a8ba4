"""contentlens.operators."""
