"""Filing analytics on Spark: tagged facts, statements, sections and comparisons as DataFrames."""

__version__ = "0.1.0"
