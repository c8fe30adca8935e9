"""Operators on columns, vectors and result tables."""
