"""A PySpark-native engine for semantic 3-D city data."""
