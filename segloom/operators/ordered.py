"""Operators that go through rows in order, a group at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from segloom.shipping import ship

_ROWS = 8192


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def out_batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Groups whole within partitions, their rows in order. One shuffle, whatever the number of groups."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def spread(df: DataFrame) -> DataFrame:
    """df evenly over all cores where it is so small that its files' own parts may be fewer than those.

    Beyond the size of one part for each core, the scan gives parts enough, and nothing is shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    part = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * part else df


def through(df: DataFrame, keys: list[str], order: list[str], step: Callable[[Iterator[dict]], Iterable[dict]], schema: str | StructType) -> DataFrame:
    """Apply step to the rows of each group in order; step may yield while it reads, so groups need not fit in memory."""
    ship(df.sparkSession)
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow, key = to_arrow_schema(kind), itemgetter(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return out_batches((out for _, own in groupby(rows_of(batches), key) for out in step(own)), arrow)

    return dealt(df, keys, order).mapInArrow(run, kind)
