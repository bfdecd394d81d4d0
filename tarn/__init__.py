"""Spark-native text search and corpus analytics."""
