"""Operators for training-data pipelines. Nothing else in finscan imports this package."""
