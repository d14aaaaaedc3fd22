"""Batch analytics for large photo collections, declared on PySpark DataFrames."""
