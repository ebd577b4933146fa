"""Palimpsest: memory analytics on Spark.

DataFrame operators over timestamped memories, embedding vectors, entity graphs, bi-temporal facts and message streams.
"""

__version__ = "0.1.0"
