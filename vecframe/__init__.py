"""vecframe: vector, text and metadata search with aggregation over Spark DataFrames."""

__version__ = "0.1.0"
