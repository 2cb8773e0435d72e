"""A PySpark-native engine that finds, scores, masks and reports sensitive data."""
