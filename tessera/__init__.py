"""Tessera: a Spark-first analytics engine for page-oriented document sets."""

__version__ = "0.1.0"
