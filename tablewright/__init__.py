"""Spark-native table toolkit: conflict-aware writes, partitioning, views and catalog on plain Parquet."""

__version__ = "0.1.0"
