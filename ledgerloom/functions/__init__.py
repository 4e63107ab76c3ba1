"""Scalar rules as Column expressions."""
