"""Operators for large-scale training-data pipelines, each usable on any DataFrame with the columns it names."""
