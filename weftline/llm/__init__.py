"""Operators for building training data from a documents table."""
