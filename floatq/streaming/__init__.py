"""Ingestion of columns as streams."""
