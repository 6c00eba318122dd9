"""Quillstone: a PySpark-native text-privacy analytics engine."""
