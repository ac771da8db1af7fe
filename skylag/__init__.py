"""Flight-delay analytics on Spark: features, risk, quality, models and drift."""

__version__ = "0.1.0"
