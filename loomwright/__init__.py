"""A PySpark-native engine for columns of JSON documents."""
