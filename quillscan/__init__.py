"""quillscan: a PySpark-native static-analysis and corpus-processing engine."""
