"""Spark-native sampling, reconstruction and assessment of gridded scalar fields."""
