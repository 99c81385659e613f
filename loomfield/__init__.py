"""Loomfield: a PySpark-native engine for survey microdata and large-table data work."""

__version__ = "0.1.0"
