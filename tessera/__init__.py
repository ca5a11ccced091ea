"""Spark-first retrieval analytics: text, graph, vector and fusion operators as DataFrames."""
