"""Structured Streaming ingest built on the batch operators."""
