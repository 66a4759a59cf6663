"""Scalar functions: columns in, a column out, all built from Spark's own expressions."""
