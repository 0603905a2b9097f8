"""Associative retrieval and corpus processing on Spark DataFrames."""
