"""Spark-native analytics over evidence-carrying knowledge graphs."""
