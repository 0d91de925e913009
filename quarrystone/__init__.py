"""Spark-first hybrid retrieval and corpus analytics."""
