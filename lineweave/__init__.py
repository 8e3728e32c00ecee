"""PySpark-native engine for aligning noisy ordered observations to scripts and for interval algebra."""

__version__ = "0.1.0"
