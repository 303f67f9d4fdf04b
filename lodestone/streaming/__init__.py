"""Incremental indexing of watched folders."""
