"""Relational algebra on Spark: relations are duplicate-free sets of tuples, computed as lazy DataFrames."""
