"""Audit job: every profile figure as one long table, and the report folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..config import BrandScoreSettings
from ..operators import audit
from ..sources import tables


def _long(df: DataFrame, section: str) -> DataFrame:
    """Wide single-row aggregate as (section, item, value text) rows."""
    cells = [F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in df.columns]
    return df.select(F.lit(section).alias("section"), F.explode(F.array(*cells)).alias("x")).select("section", "x.*")


def report(tweets: DataFrame) -> DataFrame:
    """Figures of the audit as (section, item, value).

    One aggregate gives all that needs a single scan; duplicates, links and authors
    have a shuffle of their own.
    """
    dup = audit.duplicates(tweets).select(F.lit("duplicates").alias("section"), F.col("kind").alias("item"), F.col("n").cast("string").alias("value"))
    links = audit.link_validity(tweets).select(
        F.lit("valid_links").alias("section"), F.col("kind").alias("item"), F.col("valid").cast("string").alias("value")
    )
    parts = [audit.figures(tweets), dup, links, _long(audit.authors(tweets), "authors")]
    return reduce(DataFrame.unionByName, parts)


def run(tweets: DataFrame, out_dir: str, settings: BrandScoreSettings = BrandScoreSettings()) -> None:
    tables.write_report(report(tweets), f"{out_dir}/audit")
    tables.write_report(audit.top_brands(tweets), f"{out_dir}/top_brands")
    tables.write_report(audit.brand_scores(tweets, settings), f"{out_dir}/brand_scores")
