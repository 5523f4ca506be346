"""Segment analytics on Spark: positioned text segments, region algebra and evaluation metrics as DataFrame operators."""

from __future__ import annotations

__version__ = "0.1.0"
