"""contentlens.sources."""
