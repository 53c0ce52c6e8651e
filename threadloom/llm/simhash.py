"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that
differ in at most two bits either differ in at most one bit of the first
segment or agree in the second. So the Hamming ball of radius one around the
first segment (33 keys) is looked up in the table of first segments, the second
segment (radius zero) in the table of second segments, and what is found is
verified on all 64 bits. Fingerprints are distinct at this point: copies join
through their fingerprint, never with each other.

A segment value may be shared by very many fingerprints (a family of near
copies). The pairs below such a value grow with its square, so fingerprints that
would look up a value held by more than `HOT_BUCKET` are linked by the ball of
radius one around the whole fingerprint instead: two fingerprints within two
bits have a common point within one bit of both, and all that share a point are
within two bits. 65 rows each, one minimum per point, and no link is lost.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; repeated rows give repeated
result rows; a null id is kept, its component is the smallest id reachable, null
only if there is none; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stage, texts
from .components import components
from .registry import query, table

SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints below a segment value up to which its pairs are verified one by one.
HOT_BUCKET = 256


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """SimHash of the lower-cased words' shingles, repeats included; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = words if width == 1 else list(zip(*(words[i:] for i in range(width))))
    if len(words) <= width:
        shingles = [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(s), SEED) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = SHINGLE_WORDS) -> DataFrame:
    """`id` and `fp`, the fingerprint as a signed long, one row per row read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width) for t in texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, work, "id long, fp long")


def _ball(value: Column, bits: int) -> Column:
    """The value and all values one bit away."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(bits)])
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2


def links(distinct: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links `a`, `b` that connect all fingerprints `fp` within two bits of each other."""
    both = distinct.select("fp", F.shiftrightunsigned("fp", 32).alias("high"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))
    probes = both.select("fp", F.explode(_ball(F.col("high"), 32)).alias("key"))
    crowded = lambda segment: both.groupBy(F.col(segment).alias("key")).count().where(F.col("count") > hot_bucket).select("key")
    hot_high, hot_low = stage(crowded("high"), "hot-high"), stage(crowded("low"), "hot-low")
    first = both.select(F.col("high").alias("key"), F.col("fp").alias("other")).join(hot_high, "key", "left_anti")
    second = both.select(F.col("low").alias("key"), "fp").join(hot_low, "key", "left_anti")
    by_high = probes.join(first, "key").where((F.col("fp") < F.col("other")) & _near("fp", "other")).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    by_low = second.join(second.select("key", F.col("fp").alias("other")), "key").where((F.col("fp") < F.col("other")) & _near("fp", "other")).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    in_crowd = probes.join(hot_high, "key", "left_semi").select("fp").union(both.join(hot_low.withColumnRenamed("key", "low"), "low", "left_semi").select("fp")).distinct()
    points = in_crowd.select("fp", F.explode(_ball(F.col("fp"), 64)).alias("point"))
    centre = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("point", "a")
    by_point = points.join(centre, "point").where("fp > a").select("a", F.col("fp").alias("b"))
    return by_high.union(by_low).union(by_point)


def cluster(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = SHINGLE_WORDS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """`id`, `fp`, `component` (smallest id among all rows linked, directly or by others) of every row."""
    rows = stage(fingerprints(docs, text, id_col, width), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = stage(components(links(distinct.select("fp"), hot_bucket)).select(F.col("node").alias("fp"), "root"), "roots")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def row_links(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = SHINGLE_WORDS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links `a`, `b` of ids that connect the rows as `cluster` does, for a job that has further links."""
    rows = stage(fingerprints(docs, text, id_col, width), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    least = lambda fp, as_: distinct.select(F.col("fp").alias(fp), F.col("least").alias(as_))
    near = links(distinct.select("fp"), hot_bucket).join(least("a", "x"), "a").join(least("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return near.union(rows.join(distinct, "fp").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay: of each component, those with its smallest id.

    Rows sharing that id (repeats of one row) are cut to one; a component
    without any id keeps one row as well. The columns are those of the input.
    """
    numbered = stage(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*[docs[c] for c in docs.columns]).alias("row")), "numbered")
    flat = numbered.select("row_id", F.col("row")[text].alias("text"), F.col("row")[id_col].cast("long").alias("id"))
    placed = cluster(flat, "text", "row_id")  # components of rows
    best = placed.join(flat.select(F.col("row_id").alias("id"), F.col("id").alias("doc")), "id").groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "id")).alias("best"))
    return numbered.join(best.select(F.col("best.id").alias("row_id")), "row_id", "left_semi").select("row.*")


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = cluster(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
