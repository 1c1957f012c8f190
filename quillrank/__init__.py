"""Hybrid retrieval and data processing on Spark: dense, lexical and late-interaction ranking as DataFrames."""

__version__ = "0.1.0"
