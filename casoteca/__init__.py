"""Epidemiological case analytics on PySpark DataFrames."""
