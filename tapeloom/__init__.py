"""Spark-native operators over archives of timed recordings."""
