"""Content search over versioned text collections, expressed in Spark DataFrames."""

__version__ = "0.1.0"
