"""Operators that a large training-data pipeline needs, each a Spark job over whole tables."""
