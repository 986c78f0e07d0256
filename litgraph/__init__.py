"""A PySpark-native analytics engine for bibliographic and citation graphs."""
