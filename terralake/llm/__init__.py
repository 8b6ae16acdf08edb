"""Operators for training-data pipelines, one module each, and the queries that apply them to the given tables."""
