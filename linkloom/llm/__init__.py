"""Operators for text corpora and training data. Nothing outside this subpackage imports it."""
