"""Spark-native table, time-series and calendar engine."""
