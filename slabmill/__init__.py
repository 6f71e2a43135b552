"""Spark-native analytics for graded collectibles markets."""
