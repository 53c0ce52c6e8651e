"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, scratch_path

#: Bytes of texts that a Python worker is handed at once.
BATCH_BYTES = 16 << 20

_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Have Arrow batches end by bytes, so that very long texts do not pile up in one batch."""
    if int(spark.conf.get(_BATCH_CONF, str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` with batches bounded in bytes."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The table written to the shared scratch folder (or `path`) and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_path(spark, folder)


def numbered(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """`row_id`, the text (null: empty) as `text`, and the kept columns.

    `row_id` tells rows apart whose ids are null or repeated. It follows the
    layout of the scan, so it is staged along with what is derived from it.
    """
    return df.select(F.monotonically_increasing_id().alias("row_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *[F.col(c) for c in keep])


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """Rows of the highest counts, at most `limit`, and all rows of any count taken.

    The cut is read off a histogram of the counts (some thousand bars whatever
    the table), so no task sorts or gathers the rows.
    """
    c = F.col(count)
    bar = F.when(c < 256, c).otherwise(256 + F.floor(16 * F.log2(c / 256.0))).cast("long")
    cut, taken = None, 0
    for at, n in sorted(df.groupBy(bar.alias("bar")).count().collect(), reverse=True):
        taken += n
        if taken > limit:
            break
        cut = at
    return df.where(bar >= cut) if cut is not None else df.limit(0)


def held_out(id_col: str, parts: int) -> Column:
    """True for the rows set aside: crc32 of the id as text is divisible by `parts` (a null id is text "")."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == 0


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
