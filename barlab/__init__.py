"""Spark-native event-study and trade-tape analytics."""
