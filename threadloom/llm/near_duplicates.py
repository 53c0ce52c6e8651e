"""Near-duplicates by SimHash and by the Jaccard similarity of word shingles, complete and exact.

Two texts are linked if their fingerprints (`simhash`) differ in two bits or fewer, or
if their sets of `WIDTH`-word shingles have a similarity of `SIMILARITY` or more: near
copies with more edits than two bits allow for. The latter components come from the
similarity join of `jaccard_join`, which builds whole sets only for texts that share a
rare shingle with another; it starts from the links of the fingerprints, so its components
are those of all links.

Defined results: as of `simhash.keep_one`; words are lower-cased; a text of fewer
words than a shingle is one shingle; texts with equal sets (so all without
words) are linked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard_join, simhash
from .common import stage

WIDTH = 5
SIMILARITY = 0.8


def cluster(rows: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, rounds: int = jaccard_join.ROUNDS, start: DataFrame | None = None) -> DataFrame:
    """`row_id`, `component` (smallest row id reachable) of every row of `row_id`, `text`, a staged table; `start` has further links `a`, `b` of row ids."""
    return jaccard_join.cluster(rows, width, round(100 * similarity), rounds=rounds, link_empty=True, start=start).select("row_id", "component")


def cluster_by_both(rows: DataFrame) -> DataFrame:
    """As `cluster`, with the links of the fingerprints as well."""
    return cluster(rows, start=simhash.row_links(rows, "text", "row_id"))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay: of each component, one with its smallest id. The columns are those of the input."""
    numbered = stage(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*[docs[c] for c in docs.columns]).alias("row")), "numbered")
    flat = numbered.select("row_id", F.coalesce(F.col("row")[text].cast("string"), F.lit("")).alias("text"), F.col("row")[id_col].cast("long").alias("id"))
    placed = cluster_by_both(flat.select("row_id", "text"))
    best = placed.join(flat.select("row_id", "id"), "row_id").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_id")).alias("best"))
    return numbered.join(best.select(F.col("best.row_id").alias("row_id")), "row_id", "left_semi").select("row.*")
