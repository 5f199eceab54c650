"""lexweave: a PySpark-native engine for versioned document corpora."""
