"""Predicate transfer for PySpark: multi-join queries whose tables are reduced before any join."""
