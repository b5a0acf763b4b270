"""Document-corpus engine on PySpark: sources, scalar functions, operators, streams, queries."""

__version__ = "0.2.0"
