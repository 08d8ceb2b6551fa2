"""Spark-native analytics for design-screening tables."""
