"""Lodeline: evidence-graph analytics on Spark DataFrames."""
