"""A PySpark-native product-ranking analytics engine."""
