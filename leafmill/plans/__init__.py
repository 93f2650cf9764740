"""Whole jobs: the batch ingest job and the registered queries with their SQL."""
