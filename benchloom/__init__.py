"""benchloom: a Spark-native engine for wrangling and evaluating sensor recordings."""

__version__ = "0.1.0"
