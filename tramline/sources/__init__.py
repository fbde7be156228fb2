"""Readers of catalogue pages, dictionaries and stored tables."""
