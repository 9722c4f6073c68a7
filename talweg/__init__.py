"""talweg: a Spark-native engine for candidate matching, hybrid retrieval and text data processing."""

__version__ = "0.1.0"
