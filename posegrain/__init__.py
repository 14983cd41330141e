"""Spark-native analytics for mixture-based keypoint uncertainty and the data pipelines around it."""

__version__ = "0.1.0"
