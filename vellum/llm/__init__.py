"""Operators for training-data pipelines. Nothing else in vellum imports this subpackage."""
