"""Spark-first engine for ordered item collections: resolve, reconcile, relate and rebuild them."""

__version__ = "0.1.0"
