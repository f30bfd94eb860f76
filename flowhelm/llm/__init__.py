"""Operators for training-data pipelines on large text corpora."""
