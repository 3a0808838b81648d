"""Operators of a training-data pipeline, each one Spark job over whole tables."""
