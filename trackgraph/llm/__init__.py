"""Operators for text corpora that are prepared for training."""
