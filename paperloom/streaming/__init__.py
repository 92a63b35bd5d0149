"""Structured Streaming forms of ingest, change detection and cleanup."""
