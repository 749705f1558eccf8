"""A PySpark-native library for document corpora, their graphs and decision records."""
