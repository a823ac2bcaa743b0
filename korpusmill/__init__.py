"""Corpus analytics on Spark: retrieval, graph, decision-log and text operators as DataFrame jobs."""
