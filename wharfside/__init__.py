"""Catalog discovery analytics on Spark: DataFrame operators over crawled agent catalogs."""

__version__ = "0.1.0"
