"""Spark-native functions."""
