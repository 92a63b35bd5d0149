"""paperloom: document-corpus ingest, reconciliation and search as Spark jobs."""
