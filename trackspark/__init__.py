"""Proximity analytics on moving-object tracks, on Spark DataFrames."""
