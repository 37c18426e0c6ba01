"""A PySpark-native hybrid search engine for encyclopedia-style collections."""
