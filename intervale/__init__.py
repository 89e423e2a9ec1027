"""Spark-native analytics for point events, time intervals, sampled signals and their groups."""
