"""tidemark: point-in-time analytics and data preparation on PySpark."""

__version__ = "0.1.0"
