"""Label consensus, agreement and annotation-quality operators for Spark DataFrames."""

__version__ = "0.1.0"
