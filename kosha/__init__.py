"""kosha: a PySpark-native retrieval-analytics engine."""
