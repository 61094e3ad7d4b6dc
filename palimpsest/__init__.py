"""Spark-native code retrieval, version analytics and corpus preparation."""
