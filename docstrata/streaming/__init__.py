"""Structured Streaming forms of ingest, de-duplication and quality logs."""
