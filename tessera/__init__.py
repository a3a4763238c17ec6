"""Raster mosaic analytics on Spark DataFrames."""
