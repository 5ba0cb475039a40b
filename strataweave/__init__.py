"""Layered property-graph analytics on Spark DataFrames."""
