"""tributary: a PySpark-native replication, change-data-capture and corpus engine."""

__version__ = "0.1.0"
