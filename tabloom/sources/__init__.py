"""Readers, writers, memoised tables, the feature store and run records."""
