"""Spark-native analytics of telephone-call signalling traces."""
