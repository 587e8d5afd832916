"""Structured Streaming ingest and counts."""
