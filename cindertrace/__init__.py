"""Geo-temporal event analytics on PySpark DataFrames."""
