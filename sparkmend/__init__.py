"""A Spark-native engine for judging, repairing and querying imperfect data."""
