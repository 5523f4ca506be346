"""Tables that are written before they are read more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from segloom.shared import shared_dir


def settled(df: DataFrame) -> DataFrame:
    """df by way of a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
