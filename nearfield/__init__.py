"""Nearest-neighbour analytics on Spark DataFrames."""
