"""Analytics over ordered data (token streams, timelines, signals) as PySpark DataFrame transformations."""

__version__ = "0.1.0"
