"""Corpus search, retrieval and verification operators on Spark DataFrames."""
