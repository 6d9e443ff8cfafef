"""quillmark: a PySpark-native engine for transcript quality analytics at corpus scale."""
