"""Spark-native name linkage and analytics."""
