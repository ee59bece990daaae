"""Structured Streaming ingest of readings."""
