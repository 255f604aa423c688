"""factgraph: a Spark-native engine for code-intelligence questions over fact tables."""

__version__ = "0.1.0"
