"""Heterogeneous treatment-effect analytics on Spark DataFrames."""
