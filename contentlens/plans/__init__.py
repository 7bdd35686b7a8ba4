"""contentlens.plans."""
