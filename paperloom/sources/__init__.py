"""Readers and writers: office and mail files, page tables, state and run tables."""
