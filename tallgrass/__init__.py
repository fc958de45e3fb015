"""Tallgrass: a PySpark-native engine for document collections and structured facts."""
