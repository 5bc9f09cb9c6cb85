"""Context-budget analytics on Spark: every conversation is a partition of an ordered relation."""

__version__ = "0.1.0"
