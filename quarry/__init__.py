"""Part of quarry, a PySpark-native retrieval analytics engine."""
