"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, a temporary one in local mode and an error on a cluster."""
    context = spark.sparkContext
    jdir = context._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="segloom-")
    context.setCheckpointDir(found)
    return context._jsc.sc().getCheckpointDir().get()
