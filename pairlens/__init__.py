"""pairlens: Spark-native analytics over typed interaction graphs."""

__version__ = "0.1.0"
