"""Operators for preparing large training-text corpora."""
