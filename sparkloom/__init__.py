"""A PySpark-native engine for documents, ordered containers, versioned stores and SQL."""
