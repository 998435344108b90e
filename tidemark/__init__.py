"""Ordered-sequence analytics on Spark DataFrames."""
