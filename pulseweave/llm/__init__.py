"""Operators for training-data preparation, and their registered queries."""
