"""wikiloom: a PySpark-native engine for wiki passage retrieval and data processing."""
