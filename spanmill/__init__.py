"""Spark-native analytics for traces of language-model agents.

Every operator is a function from DataFrames to DataFrames. See the modules in
``operators`` (batch), ``streaming`` (Structured Streaming jobs), ``sources``
(readers and sinks) and ``functions`` (column expressions).
"""

__version__ = "0.1.0"
