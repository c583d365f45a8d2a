"""Findings over large collections of architecture graphs, as Spark DataFrames."""

__version__ = "0.1.0"
