"""Operators for training data: mapping, consensus, masking, truncation, encoding, leaks, pieces."""
