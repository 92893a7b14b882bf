"""Spark-native analytics over media timelines, packets, frames and event streams."""

__version__ = "0.1.0"
