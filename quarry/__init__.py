"""Quarry: an analytics engine of DataFrame and Spark SQL plans."""
