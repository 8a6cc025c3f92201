"""Spatiotemporal and raster analytics on Spark DataFrames."""
