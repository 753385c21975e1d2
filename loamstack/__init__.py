"""Spark-native retrieval, answer-validation and corpus analytics."""
