"""From single messages to customer/support exchanges.

Every message belongs to at most one brand (the author of an outbound message,
the handle an inbound one opens with), so `brand` is a column and all brands are
rebuilt in one job. Joins are on message ids. A parent or reply id shared by very
many messages makes the left side of a join skewed while the right side stays
unique, the case adaptive skew joins split. Messages without an id to follow are
spread by their own id rather than piling up on null. Links are followed on ids
alone; texts are shuffled once, when it is known which are needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..session import staged


def brand_slice(tweets: DataFrame, brand: str | None = None) -> DataFrame:
    """Messages of a brand (all brands when None): outbound by author, inbound by handle."""
    author = F.lower("author_id")
    sliced = tweets.withColumn("author_lower", author).withColumn(
        "brand",
        F.when(F.col("inbound"), tx.extract_mention(F.col("text"), strip_first=False)).when(~F.col("inbound"), author),
    )
    return sliced.filter(F.col("brand").isNotNull() if brand is None else F.col("brand") == brand.lower())


def id_table(tweets: DataFrame, brand: str | None = None) -> DataFrame:
    """Brand, direction and ids of the messages of a brand, written once.

    The brand is a pattern over the text; every step that follows links reads this
    narrow table instead of working it out again.
    """
    columns = ["tweet_id", "brand", "author_lower", "author_id", "inbound", "in_response_to_tweet_id", "response_tweet_id"]
    return staged(brand_slice(tweets, brand).select(*columns), "ids")


def replies_of(sliced: DataFrame) -> DataFrame:
    """Messages written by the brand itself."""
    return sliced.filter(F.col("author_lower") == F.col("brand")).select(
        F.col("tweet_id").alias("response_id"),
        F.col("brand").alias("r_brand"),
        F.col("in_response_to_tweet_id").alias("r_parent"),
        *([F.col("text").alias("r_text")] if "text" in sliced.columns else []),
        F.col("author_id").alias("support_author"),
    )


def customers_of(sliced: DataFrame, pick: str = "last") -> DataFrame:
    """Inbound messages with the reply id they name; id 0 counts as missing."""
    choose = tx.last_id if pick == "last" else tx.first_id
    return sliced.filter("inbound").withColumn("named_reply", F.nullif(choose(F.col("response_tweet_id")), F.lit(0)))


def pairs_by_reply_id(sliced: DataFrame, pick: str = "last") -> DataFrame:
    """Method 1: the reply the customer's message names."""
    c = customers_of(sliced, pick).filter(F.col("named_reply").isNotNull())
    r = replies_of(sliced)
    return c.join(r, (c["named_reply"] == r["response_id"]) & (c["brand"] == r["r_brand"]))


def first_child(sliced: DataFrame) -> DataFrame:
    """Per customer message the brand's first reply naming it as parent.

    An aggregate over ids, so a message with very many replies is reduced before
    the shuffle.
    """
    return (
        replies_of(sliced).filter(F.col("r_parent").isNotNull())
        .groupBy(F.col("r_parent").alias("parent"), F.col("r_brand").alias("c_brand"))
        .agg(F.min("response_id").alias("child_id"))
    )


def pairs_by_parent(sliced: DataFrame) -> DataFrame:
    """Method 2, for customer messages method 1 leaves out."""
    done = pairs_by_reply_id(sliced).select("tweet_id")
    left = customers_of(sliced).join(done, "tweet_id", "left_anti")
    child = first_child(sliced)
    return left.join(child, (left["tweet_id"] == child["parent"]) & (left["brand"] == child["c_brand"])).select(
        *[left[c] for c in left.columns], F.col("child_id").alias("response_id")
    )


def pair_replies(sliced: DataFrame, pick: str = "last") -> DataFrame:
    """Both methods in one pass: the named reply if it holds, else the first child.

    One row per (customer message, reply), ids only; texts are attached once at the
    end, when all ids are known.
    """
    c = customers_of(sliced, pick).select("brand", "tweet_id", "in_response_to_tweet_id", "named_reply")
    named = F.coalesce(F.col("named_reply"), F.col("tweet_id"))
    r = replies_of(sliced).select(F.col("response_id").alias("m1_id"), "r_brand")
    by_id = c.withColumn("__key", named).join(
        r,
        (F.col("__key") == F.col("m1_id")) & (F.col("brand") == F.col("r_brand")) & F.col("named_reply").isNotNull(),
        "left",
    )
    child = first_child(sliced)
    joined = by_id.join(
        child, (F.col("tweet_id") == F.col("parent")) & (F.col("brand") == F.col("c_brand")), "left"
    )
    return (
        joined.select(
            "brand", "tweet_id", "in_response_to_tweet_id", F.coalesce("m1_id", "child_id").alias("response_id"),
            F.col("m1_id").isNotNull().alias("by_reply_id"),
        )
        .filter(F.col("response_id").isNotNull())
        .dropDuplicates(["tweet_id", "response_id"])
    )


def ancestors(pairs: DataFrame, sliced: DataFrame, depth: int = 3) -> DataFrame:
    """Adds `ancestor_ids`: up to `depth` parents in the brand's messages, nearest first."""
    known = sliced.select(
        F.col("tweet_id").alias("a_id"), F.col("brand").alias("a_brand"), F.col("in_response_to_tweet_id").alias("a_next")
    )
    out = pairs.withColumn("__next", F.col("in_response_to_tweet_id"))
    for hop in range(1, depth + 1):
        a = known.withColumnsRenamed({c: f"{c}{hop}" for c in known.columns})
        out = (
            out.withColumn("__key", F.coalesce("__next", "tweet_id"))
            .join(
                a,
                (F.col("__key") == F.col(f"a_id{hop}")) & (F.col("brand") == F.col(f"a_brand{hop}"))
                & F.col("__next").isNotNull(),
                "left",
            )
            .withColumn("__next", F.col(f"a_next{hop}"))
            .drop("__key", f"a_brand{hop}", f"a_next{hop}")
        )
    found = [F.col(f"a_id{hop}") for hop in range(1, depth + 1)]
    return out.withColumn("ancestor_ids", F.array_compact(F.array(*found))).drop("__next", *[f"a_id{h}" for h in range(1, depth + 1)])


def attach_texts(
    pairs: DataFrame, sliced: DataFrame, depth: int = 3, prepare: Callable[[Column], Column] = lambda text: text
) -> DataFrame:
    """Texts of the customer message, the reply and the ancestors, by a single join.

    Every pair lists the messages it needs, the list meets the texts once, and the
    pieces are put together per pair. `conversation_context` runs oldest first.
    `prepare` is applied to message and reply below the aggregate, so that filters
    on the result do not repeat its work.
    """
    context = F.col("ancestor_ids") if "ancestor_ids" in pairs.columns else F.array().cast("array<bigint>")
    wanted = F.concat(F.array("tweet_id", "response_id"), context)
    keys = ["brand", "tweet_id", "response_id", "in_response_to_tweet_id", "by_reply_id"]
    refs = pairs.select(*keys, F.posexplode(wanted).alias("slot", "ref_id"))
    messages = sliced.select(
        F.col("tweet_id").alias("m_id"), F.col("inbound").alias("m_inbound"), F.col("text").alias("m_text"),
        F.col("author_id").alias("m_author"), F.col("created_at").alias("m_created"),
    )
    slot = F.col("slot")
    role = F.when(F.col("m_inbound"), "customer").otherwise("support")
    line = F.concat(F.lit("["), role, F.lit("]: "), tx.clean_text(F.col("m_text")))
    pieces = refs.join(messages, F.col("ref_id") == F.col("m_id")).select(
        *keys, slot,
        F.when(slot < 2, F.struct(prepare(F.col("m_text")).alias("text"), F.col("m_author").alias("author"), F.col("m_created").alias("created"))).alias("message"),
        F.when(slot >= 2, line).alias("line"),
    )
    whole = pieces.groupBy(*keys).agg(
        F.max(F.when(slot == 0, F.col("message"))).alias("c"),
        F.max(F.when(slot == 1, F.col("message"))).alias("r"),
        *[F.max(F.when(slot == 1 + hop, F.col("line"))).alias(f"line{hop}") for hop in range(1, depth + 1)],
    )
    # concat_ws leaves out the hops that found nothing
    return whole.select(
        *keys, F.col("c.text").alias("text"), F.col("c.author").alias("author_id"), F.col("c.created").alias("created_at"),
        F.col("r.text").alias("r_text"), F.col("r.author").alias("support_author"),
        F.concat_ws(" | ", *[F.col(f"line{hop}") for hop in range(depth, 0, -1)]).alias("conversation_context"),
    )


def as_conversations(pairs: DataFrame) -> DataFrame:
    """Pairs with cleaned texts and context as conversation records, before filtering."""
    return pairs.select(
        tx.conversation_id(F.col("tweet_id"), F.col("response_id")).alias("conversation_id"),
        "brand",
        F.col("text").alias("customer_message"),
        F.col("r_text").alias("historical_support_response"),
        F.col("created_at").alias("timestamp"),
        "conversation_context",
        F.col("author_id").alias("customer_author"),
        "support_author",
        F.col("in_response_to_tweet_id").cast("string").alias("parent_tweet_id"),
        F.col("response_id").cast("string").alias("response_tweet_id"),
        tx.conversation_length(F.col("conversation_context")).alias("conversation_length"),
        F.col("tweet_id").alias("customer_tweet_id"),
    )


def flag_and_filter(conversations: DataFrame, with_word_count: bool = True) -> DataFrame:
    """Usable pairs with the private-message flag.

    Word count depends on the message alone, so testing it before the dedup
    gives the same rows and a smaller shuffle.
    """
    long_msg, long_reply, enough_words = tx.usable(F.col("customer_message"), F.col("historical_support_response"))
    keep = long_msg & long_reply & enough_words if with_word_count else long_msg & long_reply
    return conversations.filter(keep).withColumn(
        "is_dm_redirect", tx.is_dm_redirect(F.col("historical_support_response"))
    )


def dedup_messages(conversations: DataFrame) -> DataFrame:
    """First conversation of each (brand, message).

    `row_number() = 1` lets Spark keep one row per message in every map task before
    the shuffle, so a message copied very often does not load one task.
    """
    w = Window.partitionBy("brand", "customer_message").orderBy("customer_tweet_id", "response_tweet_id")
    return conversations.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def sql_conversations(staged: DataFrame) -> DataFrame:
    """SQL variant: inbound joined with outbound on the reply id as text, no list splitting."""
    i = staged.filter("is_inbound")
    o = staged.filter("NOT is_inbound").select(
        F.col("tweet_id").alias("o_id"), F.col("brand_id").alias("brand"),
        F.col("tweet_text").alias("historical_support_response"), F.col("author_id").alias("support_author"),
    )
    return i.join(o, F.col("response_tweet_id") == F.col("o_id")).select(
        F.col("tweet_id").alias("conversation_id"), "brand", F.col("tweet_text").alias("customer_message"),
        "historical_support_response", F.col("created_at").alias("timestamp"),
        F.col("author_id").alias("customer_author"), "support_author",
        F.col("in_response_to_tweet_id").alias("parent_tweet_id"), "response_tweet_id",
    )
