"""Tickloom: ordered-series analytics for market research, built on Spark DataFrames."""
