"""Spark-native analytics over networks of environmental sensors."""
