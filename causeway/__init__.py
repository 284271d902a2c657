"""Causal time-series analytics and simulation on Spark DataFrames."""
