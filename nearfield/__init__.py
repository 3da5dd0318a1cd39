"""Nearest-neighbour analytics over vector tables, on Spark DataFrames."""
