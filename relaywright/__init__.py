"""Spark-native analytics for high-volume message traffic."""
