"""Windowed stream and batch analytics on Spark DataFrames."""
