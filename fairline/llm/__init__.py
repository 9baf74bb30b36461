"""Operators for training-data pipelines: ten document operators and their queries."""
