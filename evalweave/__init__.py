"""Spark-native evaluation, selection and signal-metadata analytics."""
