"""Brindle: a PySpark-native retrieval, evidence and evaluation engine."""
