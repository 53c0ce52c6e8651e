"""Conversation preparation: from messages over a staged id table to clean exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import contract, threads
from ..session import temporary_stages
from ..sources import tables


def raw_conversations(tweets: DataFrame, brand: str | None = None, pick: str = "last", depth: int = 3) -> DataFrame:
    """Pairs with texts and `depth` messages of context; texts are read for the brand and once more to be attached."""
    ids = threads.id_table(tweets, brand)
    pairs = threads.ancestors(threads.pair_replies(ids, pick), ids, depth)
    return threads.as_conversations(threads.attach_texts(pairs, tweets, depth, threads.tx.clean_text))


def prepare(tweets: DataFrame, brand: str | None = None, pick: str = "last", depth: int = 3) -> DataFrame:
    """Conversations of one brand, or of all when `brand` is None."""
    raw = raw_conversations(tweets, brand, pick, depth)
    return threads.dedup_messages(threads.flag_and_filter(raw)).drop("customer_tweet_id")


def funnel(raw: DataFrame) -> DataFrame:
    """Rows left after each preparation step, in one pass over the raw conversations."""
    tests = threads.tx.usable(F.col("customer_message"), F.col("historical_support_response"))
    flagged = raw.select(
        "brand", "customer_message",
        tests[0].alias("msg_ok"), (tests[0] & tests[1]).alias("pair_ok"), tests[2].alias("words_ok"),
        threads.tx.is_dm_redirect(F.col("historical_support_response")).alias("dm"),
    )
    per_message = flagged.groupBy("brand", "customer_message", "words_ok").agg(
        F.count("*").alias("n"), F.count_if("msg_ok").alias("n_msg"), F.count_if("pair_ok").alias("n_pair"),
        F.count_if(F.col("pair_ok") & F.col("dm")).alias("n_dm"),
    )
    kept = F.col("n_pair") > 0
    return per_message.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("initial"),
        F.coalesce(F.sum("n_msg"), F.lit(0)).alias("after_empty_customer"),
        F.coalesce(F.sum("n_pair"), F.lit(0)).alias("after_empty_response"),
        F.coalesce(F.sum("n_dm"), F.lit(0)).alias("dm_redirects"),
        F.coalesce(F.sum(F.when(kept, F.col("n_pair") - 1)), F.lit(0)).alias("duplicates_removed"),
        F.count_if(kept & F.col("words_ok")).alias("after_short_filter"),
    ).withColumn("final", F.col("after_short_filter"))


def summarise(conversations: DataFrame) -> DataFrame:
    return conversations.agg(
        F.count("*").alias("n_conversations"),
        F.countDistinct("brand").alias("n_brands"),
        F.avg(F.length("customer_message")).alias("mean_message_chars"),
        F.avg(F.length("historical_support_response")).alias("mean_reply_chars"),
        F.avg("conversation_length").alias("mean_length"),
        F.max("conversation_length").alias("max_length"),
    )


def run(tweets: DataFrame, out_dir: str, brand: str | None = None, sample: int = 2000, fail: bool = False) -> DataFrame:
    """Prepare, write, check the contract on the written table and write a sample.

    Returns the contract findings; with `fail` an error finding raises.
    """
    with temporary_stages(tweets.sparkSession):
        prepared = prepare(tweets, brand)
        tables.write_parquet(prepared, f"{out_dir}/conversations")
    # the schema is given, as an empty result leaves no file to take it from
    written = tweets.sparkSession.read.schema(prepared.schema).parquet(f"{out_dir}/conversations")
    findings = contract.check(written, contract.CONTRACT_A)
    tables.write_report(findings, f"{out_dir}/contract")
    tables.write_csv(tables.sample_table(written, "conversation_id", sample), f"{out_dir}/sample")
    found = tweets.sparkSession.read.schema(findings.schema).json(f"{out_dir}/contract")
    if fail and not found.filter("severity = 'error'").isEmpty():
        raise ValueError("conversations break the contract, see the findings table")
    return found
