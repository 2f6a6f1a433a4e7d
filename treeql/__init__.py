"""Spark-native analytics over tree-structured text."""
