"""Whole jobs: ingest and cleanup runs, and the registered queries with their SQL."""
