"""Incremental ingest with the batch operators."""
