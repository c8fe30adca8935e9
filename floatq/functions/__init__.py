"""Scalar functions with explicit IEEE-754 rules."""
