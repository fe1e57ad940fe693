"""Weftline: a Spark-native engine for corpora of saved web pages and the queries about them."""

__version__ = "0.1.0"
