"""Kithline: record linkage, string similarity and skew-proof data processing on Spark DataFrames."""

__version__ = "0.1.0"
