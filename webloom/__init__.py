"""Spark-native analytics over fetched web corpora."""
