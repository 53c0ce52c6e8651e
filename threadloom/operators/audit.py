"""Profile of the raw message table and ranking of brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import BrandScoreSettings
from ..functions import text as tx
from ..functions.ranking import hash_order, top_per_group


def pct(part, whole):
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, 2)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls and their share, from a single scan."""
    counts = df.agg(F.count("*").alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    cells = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).alias("nulls"))
        for f in df.schema.fields
    ]
    return counts.select("__rows", F.explode(F.array(*cells)).alias("c")).select(
        "c.*", pct(F.col("c.nulls"), F.col("__rows")).alias("null_pct"), F.col("__rows").alias("rows")
    )


def duplicates(df: DataFrame, key: str = "tweet_id") -> DataFrame:
    """Rows after the first, for whole rows and for the key."""
    def extra(by: list[str], name: str) -> DataFrame:
        return df.groupBy(*by).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(
            F.lit(name).alias("kind"), "n"
        )

    return extra(df.columns, "rows").unionByName(extra([key], key))


def _directions() -> dict:
    inbound, outbound, known = F.count_if("inbound"), F.count_if(~F.col("inbound")), F.count("inbound")
    return {"inbound": inbound, "outbound": outbound, "inbound_pct": pct(inbound, known), "outbound_pct": pct(outbound, known)}


def _named(cells: dict) -> list:
    return [c.alias(name) for name, c in cells.items()]


def directions(df: DataFrame) -> DataFrame:
    return df.agg(*_named(_directions()))


def authors(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(count("author_id").alias("authors"))


def _dates() -> dict:
    """Over `__at`, the parsed time."""
    seconds = F.unix_timestamp(F.max("__at")) - F.unix_timestamp(F.min("__at"))
    return {
        "first": F.min("__at"), "last": F.max("__at"), "span_days": F.floor(seconds / 86400),
        "unparsable": F.count_if(F.col("__at").isNull() & F.col("created_at").isNotNull()),
    }


def _with_time(df: DataFrame) -> DataFrame:
    return df.withColumn("__at", tx.parse_created_at(F.col("created_at")))


def _with_lengths(df: DataFrame) -> DataFrame:
    return df.withColumns({"__chars": tx.char_count(F.col("text")), "__words": tx.word_count(F.col("text"))})


def date_range(df: DataFrame) -> DataFrame:
    return _with_time(df).agg(*_named(_dates()))


def _texts(kinds: tuple = (("min", F.min), ("max", F.max), ("mean", F.avg), ("median", F.median))) -> dict:
    """Over `__chars` and `__words`."""
    return {f"{n}_{c}": f(f"__{c}") for c in ("chars", "words") for n, f in kinds} | {"empty": F.count_if(F.col("__chars").isNull())}


def text_statistics(df: DataFrame) -> DataFrame:
    """Lengths of texts; the medians are exact, over the few distinct lengths."""
    return _with_lengths(df).agg(*_named(_texts()))


def _links() -> dict:
    r, p, n = F.count("response_tweet_id"), F.count("in_response_to_tweet_id"), F.count("*")
    return {"with_replies": r, "with_parent": p, "with_replies_pct": pct(r, n), "with_parent_pct": pct(p, n)}


def link_presence(df: DataFrame) -> DataFrame:
    return df.agg(*_named(_links()))


def figures(df: DataFrame) -> DataFrame:
    """(section, item, value text) of everything one scan can tell: nulls, directions, dates, lengths, links."""
    dates = _dates()
    sections = {
        "nulls": {c: F.count_if(F.col(c).isNull()) for c in df.columns}, "directions": _directions(),
        "dates": {k: dates[k] for k in ("span_days", "unparsable")}, "texts": _texts((("min", F.min), ("max", F.max))), "links": _links(),
    }
    wide = _with_lengths(_with_time(df)).agg(*[c.alias(f"{section}|{item}") for section, cells in sections.items() for item, c in cells.items()])
    rows = [
        F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), F.col(f"`{section}|{item}`").cast("string").alias("value"))
        for section, cells in sections.items() for item in cells
    ]
    return wide.select(F.inline(F.array(*rows)))


def link_validity(df: DataFrame) -> DataFrame:
    """Reply and parent ids that exist in the table.

    Links are counted per target before the join, so an id named very often is
    one row by then. Pieces that are no id count as links but never as valid.
    """
    pieces = df.select(F.explode(F.split("response_tweet_id", ",")).alias("p")).filter(tx.strip(F.col("p")) != "")
    replies = pieces.select(F.lit("reply").alias("kind"), F.try_element_at(tx.parse_id_list(F.col("p")), F.lit(1)).alias("target"))
    parents = df.filter(F.col("in_response_to_tweet_id").isNotNull()).select(
        F.lit("parent").alias("kind"), F.col("in_response_to_tweet_id").alias("target")
    )
    per_target = replies.unionByName(parents).groupBy("kind", "target").count()
    ids = df.select(F.col("tweet_id").alias("target")).distinct().withColumn("known", F.lit(True))
    return (
        per_target.join(ids, "target", "left").groupBy("kind")
        .agg(F.sum("count").alias("links"), F.coalesce(F.sum(F.when(F.col("known"), F.col("count"))), F.lit(0)).alias("valid"))
        .withColumn("broken", F.col("links") - F.col("valid"))
    )


def brand_rows(df: DataFrame) -> DataFrame:
    """One row per message and brand it touches: as author or as opening handle."""
    return df.withColumn("author_lower", F.lower("author_id")).withColumn(
        "target", tx.extract_mention(F.col("text"), strip_first=False)
    ).withColumn(
        "brand", F.explode(F.array_distinct(F.filter(F.array("author_lower", "target"), lambda x: x.isNotNull())))
    )


def brand_volumes(df: DataFrame) -> DataFrame:
    """Outbound and inbound messages per brand; brands are the outbound authors."""
    counted = brand_rows(df).groupBy("brand").agg(
        F.count_if(~F.col("inbound") & (F.col("author_lower") == F.col("brand"))).alias("outbound"),
        F.count_if(F.col("inbound") & (F.col("target") == F.col("brand"))).alias("inbound"),
    )
    return counted.filter(F.col("outbound") > 0).withColumn("total", F.col("outbound") + F.col("inbound"))


def top_brands(df: DataFrame, n: int = 30) -> DataFrame:
    return brand_volumes(df).orderBy(F.desc("total"), "brand").limit(n)


def opening_diversity(df: DataFrame, sample: int | None = None) -> DataFrame:
    """Share of distinct openings among the inbound messages of each brand.

    All are counted, combined before the shuffle; `sample` takes that many per
    brand in hash order instead.
    """
    inbound = df.filter("inbound").select(
        tx.extract_mention(F.col("text"), strip_first=False).alias("brand"), "tweet_id",
        tx.opening_words(F.col("text")).alias("opening"),
    ).filter(F.col("brand").isNotNull())
    picked = inbound if sample is None else top_per_group(
        inbound, ["brand"], [hash_order(F.col("tweet_id")), F.col("tweet_id")], sample, salt=F.col("tweet_id")
    )
    openings = picked.groupBy("brand", "opening").agg(F.count("*").alias("n"))
    return openings.groupBy("brand").agg(F.count("*").alias("patterns"), F.sum("n").alias("sampled")).select(
        "brand", (F.col("patterns") / F.greatest(F.col("sampled"), F.lit(1))).alias("text_diversity")
    )


def brand_scores(df: DataFrame, settings: BrandScoreSettings = BrandScoreSettings()) -> DataFrame:
    """Composite score of every brand with enough traffic, best first."""
    mine = F.col("author_lower") == F.col("brand")
    named = F.col("inbound") & (F.col("target") == F.col("brand"))
    base = brand_rows(df).groupBy("brand").agg(
        F.count_if(~F.col("inbound") & mine).alias("n_outbound"),
        F.count_if(named).alias("n_inbound"),
        F.count_if(named & F.col("response_tweet_id").isNotNull()).alias("answered"),
        F.count("in_response_to_tweet_id").alias("with_parent"),
        F.count("*").alias("n_all"),
    ).filter((F.col("n_outbound") >= settings.min_outbound) & (F.col("n_inbound") >= settings.min_inbound))
    one = F.lit(1)
    n_out, n_in = F.col("n_outbound"), F.col("n_inbound")
    ratio = n_in / F.greatest(n_out, one)
    scored = (
        base.join(opening_diversity(df, settings.sample_openings), "brand", "left")
        .withColumn("completeness", F.col("answered") / F.greatest(n_in, one))
        .withColumn("parent_ratio", F.col("with_parent") / F.greatest(F.col("n_all"), one))
        .withColumn("diversity", F.coalesce("text_diversity", F.lit(0.0)))
        .withColumn(
            "score",
            0.15 * F.least(n_out / 10000, F.lit(1.0)) + 0.15 * F.least(n_in / 10000, F.lit(1.0))
            + 0.25 * F.col("completeness") + 0.20 * F.least(F.col("diversity"), F.lit(1.0))
            + 0.15 * F.least(ratio, F.lit(1.5)) / 1.5 + 0.10 * F.col("parent_ratio"),
        )
    )
    return scored.select(
        "brand", "n_outbound", "n_inbound",
        F.round("completeness", 4).alias("conversation_completeness"),
        F.round("parent_ratio", 4).alias("parent_link_ratio"),
        F.round("diversity", 4).alias("text_diversity"),
        F.round(ratio, 4).alias("inbound_outbound_ratio"),
        F.round("score", 4).alias("composite_score"),
    ).orderBy(F.desc("composite_score"), "brand")
