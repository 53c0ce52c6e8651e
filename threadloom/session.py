"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "threadloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with adaptive execution, UTC and Arrow; sizes are left to the cluster."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by `spark.checkpoint.dir`.

    A machine-local folder is made only when the session itself is local, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="threadloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_OWNED: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """New, unused path below the scratch folder, owned by the innermost `temporary_stages`."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[None]:
    """Whatever is staged inside is deleted at the end, so a job leaves its results alone.

    For jobs that write their results inside the block: frames that still read a
    stage cannot be used after it.
    """
    _OWNED.append([])
    try:
        yield
    finally:
        for path in _OWNED.pop():
            delete_path(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written to the scratch folder and read back.

    Cuts the lineage: later stages start from files that outlive any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
