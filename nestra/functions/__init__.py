"""Scalar functions and functions of ARRAY columns."""
