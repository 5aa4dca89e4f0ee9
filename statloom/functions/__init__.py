"""Scalar functions: special functions, distributions, vectors."""
