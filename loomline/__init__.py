"""loomline: a PySpark-native engine for preparing document corpora."""
