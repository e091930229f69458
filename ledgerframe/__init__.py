"""Typed, versioned document families as Spark DataFrames."""
