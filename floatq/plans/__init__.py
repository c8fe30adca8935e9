"""What to compute, checked when it is built: predicates, expressions and aggregations."""
