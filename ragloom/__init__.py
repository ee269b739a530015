"""ragloom: a PySpark-native engine for retrieval-augmented QA analytics."""
