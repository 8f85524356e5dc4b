"""Readers of url lists and sitemaps."""
