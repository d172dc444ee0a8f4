"""Operators and queries for training-data preparation at scale."""
