"""textmill: full-text search and document analytics as plain Spark DataFrames."""

__version__ = "0.1.0"
