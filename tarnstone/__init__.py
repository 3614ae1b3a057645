"""Tarnstone: search, semi-structured and raster analytics as PySpark DataFrame operators."""
