"""Operators for large training-data pipelines. Nothing else in quarry imports this subpackage."""
