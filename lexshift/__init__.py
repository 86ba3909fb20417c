"""lexshift: PySpark-native measurement of lexical change between two halves of a corpus."""

__version__ = "0.1.0"
