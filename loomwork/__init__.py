"""loomwork: text, web-graph and feature analytics as plain Spark DataFrame plans."""

__version__ = "0.1.0"
