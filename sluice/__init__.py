"""Predicate transfer and training-data operators on PySpark."""
