"""delimkit: a PySpark-native engine for exploring large delimited text files and tables."""
