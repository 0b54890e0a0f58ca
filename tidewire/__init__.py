"""tidewire: a PySpark-native engine for news-style document streams and training corpora."""

__version__ = "0.1.0"
