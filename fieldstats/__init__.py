"""Grouped environmental statistics on Spark DataFrames."""
