"""The raw message table: schema, CSV reader and SQL-style staging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TWEET_SCHEMA = T.StructType([
    T.StructField("tweet_id", T.LongType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("inbound", T.BooleanType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("response_tweet_id", T.StringType()),
    T.StructField("in_response_to_tweet_id", T.DoubleType()),
])


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """Raw CSV with quoted newlines.

    Quoted newlines rule out splitting one file, so store large inputs as many
    files or convert them to Parquet once and read that.
    """
    raw = (
        spark.read.schema(TWEET_SCHEMA).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )
    # the parent id is stored as a float text; ids are longs here
    return raw.withColumn("in_response_to_tweet_id", F.col("in_response_to_tweet_id").cast("bigint"))


def stage(tweets: DataFrame) -> DataFrame:
    """Staged messages: text ids, brand of outbound rows, rows without text dropped."""
    inbound = F.col("inbound").cast("boolean")
    author = F.col("author_id").cast("string")
    return tweets.filter(F.col("text").isNotNull()).select(
        F.col("tweet_id").cast("string").alias("tweet_id"),
        author.alias("author_id"),
        inbound.alias("is_inbound"),
        "created_at",
        F.col("text").alias("tweet_text"),
        "response_tweet_id",
        "in_response_to_tweet_id",
        F.when(~inbound, author).alias("brand_id"),
    )
