"""Quillon: document quality control and corpus operators as PySpark DataFrames."""
