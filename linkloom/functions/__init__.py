"""Scalar functions as Column expressions, and the few Arrow UDFs."""
