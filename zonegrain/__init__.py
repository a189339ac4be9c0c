"""Volumes, textures and grades as Spark DataFrames."""
