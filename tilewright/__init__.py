"""Raster tables and cell algebra on Spark DataFrames."""
