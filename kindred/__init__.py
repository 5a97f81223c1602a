"""kindred: record linkage and deduplication on Spark DataFrames."""

__version__ = "0.1.0"
