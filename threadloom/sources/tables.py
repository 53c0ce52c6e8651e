"""Readers and writers of the tables and reports the jobs exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..config import SEED
from ..functions.ranking import sample_rows


def write_parquet(df: DataFrame, path: str, partition_by: str | None = "brand") -> None:
    """Conversations as Parquet, replacing what was there, laid out by brand."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; quotes are doubled so that the reader below restores the text."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def write_table_format(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Write in a table format; False when the format is not installed."""
    try:
        df.write.mode("overwrite").format(fmt).save(path)
        return True
    except Exception as e:  # the class differs between Spark releases
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "Failed to find" in str(e):
            return False
        raise


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sample_table(df: DataFrame, key: str, n: int = 2000, seed: int = SEED) -> DataFrame:
    """Fixed-size reproducible sample."""
    return sample_rows(df, key, n, seed)


def blanks_to_null(df: DataFrame, blanks: tuple[str, ...] = ("", "nan", "NaN")) -> DataFrame:
    """Blank and NaN cells as null, for tables that came through CSV."""
    def tidy(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.when(~c.isin(*blanks), c).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), c).alias(f.name)
        return c

    return df.select(*[tidy(f) for f in df.schema.fields])


def publish_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def publish_table(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 64, path: str | None = None) -> None:
    """Table of the catalog, below `path` when given; bucketed when later joins use the same key."""
    w = df.write.mode("overwrite").format("parquet")
    if path:
        w = w.option("path", path)
    if bucket_by:
        w = w.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    w.saveAsTable(name)
