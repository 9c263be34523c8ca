"""Footage catalogs, screenplay outlines and text corpora as Spark tables."""
