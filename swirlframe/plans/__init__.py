"""Composite plans: connected components and the block codec."""
