"""Clause and requirement analytics on Spark DataFrames."""
