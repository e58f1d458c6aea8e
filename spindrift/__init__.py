"""Spindrift: a PySpark-native engine for web-search style data processing."""

__version__ = "0.1.0"
