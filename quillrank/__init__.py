"""quillrank: a PySpark-native engine for evidence-aware ranking and its data."""

__version__ = "0.1.0"
