"""A Spark-native engine for typed questions about texts, and for preparing training data."""
