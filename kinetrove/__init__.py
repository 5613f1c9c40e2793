"""Spark-native analytics over keypoint ("pose") tables."""
