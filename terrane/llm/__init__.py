"""Operators for training-data problems. Nothing else in the library imports this subpackage."""
