"""Operators for training-data pipelines over documents, pages and their copies. Nothing outside this package imports it."""
