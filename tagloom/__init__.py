"""Tagloom: HTML analytics and corpus preparation on Spark DataFrames."""
