"""folia: a PySpark-native engine for OCR'd document corpora."""

__version__ = "0.1.0"
