"""Catalogue operators: DataFrames in, DataFrames out."""
