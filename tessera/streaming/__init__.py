"""Incremental analysis of a stream of sources."""
