"""Operators for training-data pipelines, each by a method of its own. Nothing else in the library imports this."""
