"""recallgrid: Spark-native retrieval, lifecycle and corpus operators for long-term memory data."""

__version__ = "0.1.0"
