"""Spark-first analytics over catalogues of source trees and text."""

__version__ = "0.1.0"
