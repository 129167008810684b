"""Circular-response sequence analytics on Spark DataFrames."""
