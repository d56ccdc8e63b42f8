"""Spark-native reconciliation of timed dialogue text, with training-data operators."""
