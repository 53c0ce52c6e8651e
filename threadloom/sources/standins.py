"""Adapters giving the driver's test tables the shapes the operators take.

Plain projections over whole tables; the oracle SQL repeats them independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tweet_columns(conv: DataFrame) -> DataFrame:
    """Row-wise part of the stand-in: everything but the reply ids."""
    tid = F.col("conv_id") * 100 + F.col("turn") + 1
    user, bot = F.col("role") == "user", F.col("role") == "assistant"
    brand = F.concat(F.lit("Brand"), (F.col("conv_id") % 4).cast("string"))
    cust = F.concat(F.lit("u"), (F.col("conv_id") % 50).cast("string"))

    def every(n):
        return F.col("conv_id") % n == 0

    said = F.when(every(9), "please help me now").otherwise(F.col("text"))
    user_text = F.concat(
        F.lit("@"), brand, F.lit(" "), said,
        F.when(every(6), F.concat(F.lit(" https://t.co/x"), F.col("turn").cast("string"))).otherwise(""),
        F.when(every(11), " i want to talk to a human").otherwise(""),
        F.when(every(13), " this is fraud").otherwise(""),
    )
    bot_text = F.concat(
        F.lit("@"), cust, F.lit(" "), F.col("text"), F.when(every(8), " Please DM us your details").otherwise("")
    )
    minute = F.timestamp_seconds(F.lit(1506816000) + tid * 60)  # from 2017-10-01 UTC
    return conv.select(
        "conv_id", "turn",
        tid.alias("tweet_id"),
        F.when(bot, brand).when(user, cust).otherwise("SystemBot").alias("author_id"),
        user.alias("inbound"),
        F.when(tid % 37 == 0, "bad date")
        .otherwise(F.date_format(minute, "EEE MMM dd HH:mm:ss '+0000' yyyy")).alias("created_at"),
        F.when(user, user_text).when(bot, bot_text).otherwise(F.col("text")).alias("text"),
        F.when(F.col("turn") > 0, tid - 1).alias("in_response_to_tweet_id"),
    )


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    nxt = (F.col("tweet_id") + 1).cast("string")
    reply = (
        F.when((F.col("conv_id") % 5 == 0) | (F.col("turn") == F.col("last_turn")), None)
        .when(F.col("conv_id") % 5 == 1, F.concat(nxt, F.lit(","), (F.col("tweet_id") + 3).cast("string")))
        .otherwise(nxt)
    )
    return (
        tweet_columns(conv).join(last, "conv_id")
        .select("tweet_id", "author_id", "inbound", "created_at", "text",
                reply.alias("response_tweet_id"), "in_response_to_tweet_id")
    )


def requests(tweets_df: DataFrame) -> DataFrame:
    """Customer messages with the signals of the earlier stages."""
    tid = F.col("tweet_id")
    return tweets_df.filter("inbound").select(
        "tweet_id", "text",
        ((tid % 100) / 100.0).alias("intent_confidence"),
        F.when(tid % 17 != 0, (tid % 10) / 10.0).alias("best_score"),
        (tid % 19 == 0).alias("generator_escalates"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled conversations."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("conversation_id"), F.col("text").alias("customer_message"), F.col("lang").alias("intent"),
        F.col("source").alias("customer_author"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("truth"),
        F.when(F.col("doc_id") % 7 == 0, "en").otherwise(F.col("lang")).alias("prediction"),
    )


def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"), (F.col("toxic") == 1).alias("truth"), (F.col("quality") == 0).alias("prediction")
    )


def rating_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human and judge ratings as JSON text, one object per item.

    Even dimensions hold an object with a score, odd ones a plain number.
    """
    from ..functions.rules import DIMENSIONS

    doc = F.col("doc_id")

    def human(d):
        return (1 + (doc * 7 + d * 3) % 5).cast("int")

    def judge(d):
        return F.least(F.greatest(human(d) + ((doc + d) % 3).cast("int") - 1, F.lit(1)), F.lit(5))

    def text(score):
        parts = [
            F.struct(score(d).alias("score")).alias(n) if d % 2 == 0 else (score(d) + F.lit(0.5)).alias(n)
            for d, n in enumerate(DIMENSIONS)
        ]
        return F.to_json(F.struct(*parts))

    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"), text(human).alias("human"), text(judge).alias("judge")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of human and judge scores (item_id, dim, human, judge)."""
    dims = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dim")
    human = 1 + (F.col("doc_id") * 7 + F.col("dim") * 3) % 5
    judge = F.least(F.greatest(human + (F.col("doc_id") + F.col("dim")) % 3 - 1, F.lit(1)), F.lit(5))
    return (
        table(spark, sf_dir, "labels").select("doc_id", dims)
        .select(F.col("doc_id").alias("item_id"), F.concat(F.lit("d"), F.col("dim").cast("string")).alias("dim"),
                human.cast("double").alias("human"), judge.cast("double").alias("judge"))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with text and reply ('' when absent), label and an assumed intent."""
    emb, doc = table(spark, sf_dir, "embeddings"), documents(spark, sf_dir)
    label = F.col("label") % 4
    intent = (
        F.when(label == 0, "playback_issues").when(label == 1, "account_access")
        .when(label == 2, "billing_payment").otherwise("general_inquiry")
    )
    return emb.join(doc.select(F.col("doc_id").alias("vec_id"), "text", "source"), "vec_id", "left").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", intent.alias("intent"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.concat(
            F.when(F.col("vec_id") % 7 == 0, "I checked your account: ").otherwise(""), F.coalesce("source", F.lit(""))
        ).alias("reply"),
    )
