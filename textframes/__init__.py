"""textframes: a PySpark-native engine for ordered frame sequences."""
