"""Tabular feature and experiment engine expressed in PySpark DataFrame operations."""
