"""Spark-native engine for curating, quota-balancing and scoring text-task corpora."""

__version__ = "0.2.0"
