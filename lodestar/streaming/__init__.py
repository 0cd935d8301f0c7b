"""Keyed running state over streams, and the same folds in batch."""
