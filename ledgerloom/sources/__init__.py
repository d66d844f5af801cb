"""Readers of registries, pages and result lists, and the stores that keep them."""
