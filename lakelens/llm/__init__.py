"""Operators of a large-scale training-data pipeline, each built on Spark."""
