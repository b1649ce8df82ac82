"""Photometric-survey analytics as Spark DataFrame jobs over all targets at once."""

__version__ = "0.1.0"
