"""tessera: a PySpark-native engine for analysing Python codebases as tables."""
