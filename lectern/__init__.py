"""Spark-native analytics for document-retrieval experiments."""
