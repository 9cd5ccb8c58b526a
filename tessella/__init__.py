"""Raster, mask and polygon analytics expressed as Spark DataFrame plans."""
