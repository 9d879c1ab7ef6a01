"""Corpus, retrieval and code-graph analytics on Spark DataFrames."""
