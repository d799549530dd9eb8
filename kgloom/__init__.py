"""A PySpark-native engine for building, curating and measuring knowledge graphs from documents."""
