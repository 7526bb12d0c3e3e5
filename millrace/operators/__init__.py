"""Loads, feeds, links, chunks and conversions."""
