"""Operators of a training-data pipeline, independent of the rest of the library."""
