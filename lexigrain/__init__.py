"""Text, document and code analytics as declarative Spark plans."""

__version__ = "0.1.0"
