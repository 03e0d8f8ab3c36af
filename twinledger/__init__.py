"""Two-sided billing comparison as Spark DataFrame functions."""

from .options import DEFAULTS, Options

__all__ = ["DEFAULTS", "Options"]
