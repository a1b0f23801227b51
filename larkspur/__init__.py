"""Larkspur: measurement and attribution analytics on Spark DataFrames."""
