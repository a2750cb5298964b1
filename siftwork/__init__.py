"""siftwork: a PySpark-native analytics engine for claim, evidence and review data."""

__version__ = "0.1.0"
