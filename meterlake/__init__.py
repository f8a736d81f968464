"""Spark-native engine for measurement files, curves and sample names."""
