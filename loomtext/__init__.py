"""loomtext: a PySpark-native text-analytics engine."""

__version__ = "0.1.0"
