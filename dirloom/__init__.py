"""PySpark-native people-directory extraction engine."""
