"""Spark-native analytics for document corpora and multi-engine table extracts."""
