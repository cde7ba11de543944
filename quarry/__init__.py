"""quarry: a PySpark-native engine that turns a corpus of files into a versioned relational model."""
