"""threadloom: load, normalise and query discussion-site archives with Spark."""

__version__ = "0.1.0"
