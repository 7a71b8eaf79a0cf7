"""Raster analytics on Spark: an image is a table with one row per pixel."""
