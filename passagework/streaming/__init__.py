"""Incremental forms of the ingest job and of the running counter."""
