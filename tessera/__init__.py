"""Volumetric (3-D array) analytics on Spark DataFrames."""
