"""Catalogue analytics on Spark: operators take DataFrames and return DataFrames."""
