"""Segmented regression and claims analytics on PySpark DataFrames."""
