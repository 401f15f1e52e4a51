"""Spark-native record linkage, record merge and corpus preparation."""
