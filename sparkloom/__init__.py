"""PySpark-native analytics for training-data, scaling and relational tables."""
