"""Spark-native analytics over contact-genomics tables, built on DataFrame operators."""

__version__ = "0.1.0"
