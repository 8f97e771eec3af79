"""msgshield — harmful-message analytics on Spark.

Corpus preparation, text scoring, flag/severity decisions, content-hashed
evidence tables, statistics, reports and exports, expressed with the
DataFrame API, MLlib and Structured Streaming.
"""

__version__ = "0.1.0"
