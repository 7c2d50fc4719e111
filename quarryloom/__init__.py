"""Code search and retrieval analytics on Spark DataFrames."""
