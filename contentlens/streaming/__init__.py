"""contentlens.streaming."""
