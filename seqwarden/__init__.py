"""Spark-native analytics over semi-structured audit logs.

Every operator takes and returns DataFrames; nothing here keeps a global session.
"""

__version__ = "0.1.0"
