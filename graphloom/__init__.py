"""Spark-native knowledge-graph, retrieval and corpus-preparation operators."""
