"""Tessera: a PySpark-native engine for byte-oriented data processing."""

__version__ = "0.1.0"
