"""Chapter-fenced knowledge graphs on Spark: DataFrames in, DataFrames out."""

__version__ = "0.1.0"
