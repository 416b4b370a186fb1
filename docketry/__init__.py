"""Spark-native analytics over collections of regulatory cases."""
