"""Spark-native retrieval, document-quality and training-data analytics."""
