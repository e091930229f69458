"""Scalar functions as Column expressions, some with Python twins for the driver."""
