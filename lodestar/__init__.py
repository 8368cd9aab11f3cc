"""Lodestar: retrieval, ranking, record-resolution and evaluation operators as Spark DataFrame jobs."""
