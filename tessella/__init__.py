"""Tessella: a document-query and text-analytics engine made of Spark plans."""

__version__ = "0.1.0"
