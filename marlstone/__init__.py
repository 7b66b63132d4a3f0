"""marlstone: similarity search, retrieval and table analytics on PySpark DataFrames."""

__version__ = "0.1.0"
