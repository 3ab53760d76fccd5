"""Spokes: knowledge-graph analytics and text processing as Spark DataFrames."""
