"""Spark-native analytics over collections of saved documents.

Operators take DataFrames and return DataFrames.  Nothing here keeps state
outside Spark, and the only side effects are the explicit sinks.
"""

__version__ = "0.1.0"
