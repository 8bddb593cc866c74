"""A Spark-native engine for long-lived, time-aware knowledge."""
