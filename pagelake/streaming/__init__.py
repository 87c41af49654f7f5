"""Incremental ingestion; an extension beyond the batch engine."""
