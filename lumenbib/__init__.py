"""lumenbib: a PySpark-native analytics engine for bibliographic data."""

__version__ = "0.1.0"
