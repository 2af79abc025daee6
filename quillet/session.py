"""Where lineage is cut and what a session needs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query go as soon as it has ended, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a session on one machine, as in tests, may do without the setting."""
    context = spark.sparkContext
    held = context.getCheckpointDir()
    if held:
        return held
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillet-checkpoint-"))
    return context.getCheckpointDir()


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Computed once and kept as a table in the shared folder, which outlives any executor.

    Columnar files take a fraction of a checkpoint's room, their sizes are known to the planner, and the shuffle files
    that made them go at once."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillet_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``cut`` made. Nothing that is still to be computed may read them."""
    for df in tables:
        path = getattr(df, "_quillet_path", None) if df is not None else None
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
