"""folioforge: a PySpark-native engine for document-object files and text corpora."""
