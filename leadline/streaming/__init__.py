"""Incremental ingest and gridding."""
