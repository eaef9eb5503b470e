"""Composed queries: ingestion, breakdown trees, serving."""
