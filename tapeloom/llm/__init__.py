"""Operators of a training-data pipeline, each a Spark job over a documents or pages table."""
