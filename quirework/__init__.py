"""quirework: set-oriented analytics over large collections of paged documents, on PySpark."""

__version__ = "0.1.0"
