"""Operators that prepare text collections for training."""
