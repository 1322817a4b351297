"""Residue-network analytics on Spark DataFrames."""
