"""A Spark-native engine for text retrieval and event-log analytics."""
