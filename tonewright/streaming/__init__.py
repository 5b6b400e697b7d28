"""Streams decoded as their bytes arrive."""
