"""Ground dialogue data in a commonsense edge table with Spark DataFrames."""

__version__ = "0.1.0"
