"""Seine: a PySpark-native engine for code search and static change-impact analysis."""

__version__ = "0.1.0"
