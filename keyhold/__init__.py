"""Bounded key deduplication and corpus processing on Spark DataFrames."""

from keyhold.config import WindowConfig

__all__ = ["WindowConfig"]
