"""Spark-native analytics for development artifacts and event logs.

Every operator is a function from DataFrames to a DataFrame; plans stay lazy
until a caller acts on them.
"""

__version__ = "0.1.0"
