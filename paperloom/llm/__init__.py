"""Operators of a training-data pipeline: scoring, deduplication, packing, filters, encoding."""
