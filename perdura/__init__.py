"""Spark-native analytics for how long cited web resources stay reachable."""
