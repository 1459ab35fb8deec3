"""Siltstone: a PySpark-native retrieval and analytics engine."""
