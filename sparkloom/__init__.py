"""Spark-first analytics over documents, events and knowledge-graph data."""
