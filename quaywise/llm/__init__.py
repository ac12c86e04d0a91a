"""Operators for training-data pipelines; nothing else in quaywise imports this subpackage."""
