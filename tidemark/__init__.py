"""Benefit, document and operations analytics on PySpark."""
