"""Spark-native engine for preparing language-model training corpora."""

__version__ = "0.1.0"
