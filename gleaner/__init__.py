"""A PySpark-native engine that mines visitor feedback."""
