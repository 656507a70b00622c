"""A PySpark-native engine for evidence retrieval, verification and corpus preparation."""
