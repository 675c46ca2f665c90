"""Operators for building training data. Nothing else in millrace imports this subpackage."""
