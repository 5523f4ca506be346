"""Reading input tables, and tables written to the shared folder to cut lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from segloom.shipping import ship

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="segloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def settle(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lost executors then never recompute what led to it.

    The files go when the session's file system closes, or by forget. The shuffles that led to it go at once, as nothing
    reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/segloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if partitions:
        df = df.coalesce(partitions)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*settled: DataFrame) -> None:
    """Delete what settle wrote, where nothing reads it any more."""
    for df in settled:
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow, with this package on the workers' path; a worker gives back its memory after each task, as it serves many."""
    ship(df.sparkSession)

    def given_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(given_back, schema)


def give_back() -> None:
    """Return to the system what this process has freed, where its C library can: it keeps tens of MB of freed arrays otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def aside(df: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """df with every column but those of own under a neutral name, and the original names: no name can clash then."""
    names = {f"aside_{i}": c for i, c in enumerate(df.columns) if c not in own}
    back = {c: a for a, c in names.items()}
    return df.toDF(*[back.get(c, c) for c in df.columns]), names


def restored(df: DataFrame, columns: list[str], names: dict[str, str], *more: str) -> DataFrame:
    """The columns under their original names, and more of df's own."""
    back = {c: a for a, c in names.items()}
    return df.select(*[df[back.get(c, c)].alias(c) for c in columns], *more)


def small(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that what Python makes of their texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
