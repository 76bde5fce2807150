"""Scalar functions as Column expressions, and their driver-side counterparts."""
