"""Spark-native analytics over a relational code graph, plus corpus operators."""
