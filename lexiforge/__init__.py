"""Corpus indexing and queries on Spark DataFrames."""
