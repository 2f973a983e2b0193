"""Columnar 3D city-model analytics on Spark DataFrames."""

__version__ = "0.1.0"
