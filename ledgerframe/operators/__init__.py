"""Dataset-level operators: DataFrames in, DataFrames out."""
