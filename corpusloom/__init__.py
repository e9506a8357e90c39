"""Spark-native retrieval analytics and corpus preparation."""
