"""Operators on frames and segments, each a DataFrame transformation."""
