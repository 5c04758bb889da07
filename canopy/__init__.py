"""Spark-native analytics over versioned trees of semi-structured documents."""
