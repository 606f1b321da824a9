"""Versioned vector analytics on Spark: vector math, nearest-neighbour search, change streams and row checks.

The subpackage ``llm`` holds the operators for training data; nothing outside it imports it.
"""

__version__ = "0.1.0"
