"""Scalar functions and Python functions."""
