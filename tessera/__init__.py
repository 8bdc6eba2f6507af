"""Tessera: raster and training-data operators on Spark DataFrames."""
