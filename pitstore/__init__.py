"""pitstore: a point-in-time analytics engine expressed as Spark DataFrame, SQL and streaming plans."""

__version__ = "0.1.0"
