"""Spark-native analytics over knowledge bases and conversations."""
