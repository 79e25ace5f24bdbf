"""Quarryline: a Spark-first knowledge-graph, hybrid-retrieval and corpus engine."""

__version__ = "0.1.0"
