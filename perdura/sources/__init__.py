"""Schemas, readers, ingest and sinks."""
