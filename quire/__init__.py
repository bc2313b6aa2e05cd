"""Relational and document analytics expressed as PySpark DataFrames."""
