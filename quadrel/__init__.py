"""quadrel: a PySpark-native engine for typed, linked records."""
