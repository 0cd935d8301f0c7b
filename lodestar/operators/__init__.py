"""Relational retrieval operators: DataFrames in, DataFrames out."""
