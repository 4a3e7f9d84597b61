"""codeloom: a Spark-native engine for searching and understanding code and text collections."""

__version__ = "0.1.0"
