"""Scalar and array functions: Spark columns and their numpy forms."""
