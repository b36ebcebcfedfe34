"""Findling: retrieval, ingestion, graph and governance operators on Spark DataFrames."""
