"""Raster files as data sources and sinks."""
