"""Continuous ingest into a saved index."""
