"""A PySpark-native engine for hierarchical address data."""

__version__ = "0.1.0"
