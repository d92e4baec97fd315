"""Structured evidence on Spark: DataFrames in, DataFrames out."""
