"""Plumbline: regional gravity-field analytics on Spark DataFrames."""
