"""A PySpark-native engine for point-in-time-safe knowledge analytics."""
