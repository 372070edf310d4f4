"""Spark-native analytics over yearly entity statements."""
