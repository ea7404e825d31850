"""A Spark-native analytics engine for software-development activity as data."""
