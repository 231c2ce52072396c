"""Resampling and analysis of sampled signals held in Spark DataFrames."""
