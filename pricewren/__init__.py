"""Catalog matching and price intelligence on PySpark DataFrames."""
