"""cairn: a PySpark-native engine for provenance-carrying evidence graphs."""
