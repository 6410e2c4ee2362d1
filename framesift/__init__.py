"""Adaptive search for distinct objects in large item → entity tables, built on Spark DataFrames."""
