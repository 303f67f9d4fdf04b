"""Indexing and search plans."""
