"""A PySpark-native analytics engine for property graphs of value flows."""
