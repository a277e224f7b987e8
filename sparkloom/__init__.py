"""Spark-native discourse, market and training-data analytics."""
