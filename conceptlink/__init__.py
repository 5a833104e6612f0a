"""Spark-first linking of source expressions to standard concepts."""
