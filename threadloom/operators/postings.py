"""Exact top-k by inner product of sparse rows, over an inverted index.

Documents become posting lists by term, with each term's largest weight. What a
query can get from a term at most is its own weight times that, so terms are
taken apart by two bounds:

1. A query's rarest terms are looked up first. The k-th best partial sum found
   is a score that k documents reach, so it is a lower bound of the k-th best.
2. The terms with the least to give, as many as together stay below that bound,
   cannot make a result on their own. Only the lists of the other terms are
   looked up; a document seen in none of them is never touched.
3. Partial sums raise the bound again. Documents that cannot reach it even with
   all the terms left out are dropped; the rest are scored on whole rows.

Long lists are cut into blocks of documents, each a join key of its own. All
weights must be positive or zero, as TF-IDF weights are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import staged
from .similarity import DECIMALS, rank_hits

#: Rarest terms of a query that the first bound comes from.
SEED_TERMS = 3
#: Documents of a posting list that are one block of it.
BLOCK_POSTINGS = 100_000
#: Bounds are compared with this much to spare: results are ordered by scores rounded to `DECIMALS`.
SLACK = 2 * 10.0**-DECIMALS


@dataclass
class PostingIndex:
    """Posting lists (term, block, d_id, weight), their sizes and largest weights (term, n, most, blocks), and the rows themselves."""

    lists: DataFrame
    stats: DataFrame
    rows: DataFrame  # id, indices, values

    def save(self, path: str) -> None:
        """Lists laid out by term, so that a search reads the files of few terms; rows by id."""
        self.lists.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/lists")
        self.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PostingIndex":
        return cls(*[spark.read.parquet(f"{path}/{part}") for part in ("lists", "stats", "rows")])

    def search(self, queries: DataFrame, k: int, floor: float = 10.0**-DECIMALS, skip_same: bool = False, seeds: int = SEED_TERMS) -> DataFrame:
        """Exact top k per query: (q_id, d_id, score, rank), of documents with any shared term and a score of `floor` or more."""
        queries = staged(queries.select("id", "indices", "values"), "query-rows")
        terms = queries.select(F.col("id").alias("q_id"), F.inline(_cells("indices", "values")))
        # One row a term; both the vocabulary and the number of blocks are known to be small.
        known = terms.join(self.stats, "term").withColumn("gives", F.col("weight") * F.col("most"))
        found = self._partial(_first(known, seeds, F.col("n"), F.col("term")), skip_same)
        bound = _kth(found, k)
        # Terms by what they can give, the least first: `up_to` is what all up to here give together.
        order = Window.partitionBy("q_id").orderBy("gives", "term").rowsBetween(Window.unboundedPreceding, 0)
        placed = known.withColumn("up_to", F.sum("gives").over(order)).join(bound, "q_id", "left").withColumn("bound", F.greatest(F.coalesce("bound", F.lit(0.0)), F.lit(floor)))
        placed = staged(placed.withColumn("left_out", F.col("up_to") < F.col("bound") - SLACK), "query-terms")
        rest = placed.groupBy("q_id").agg(F.max("bound").alias("low"), F.coalesce(F.max(F.when(F.col("left_out"), F.col("up_to"))), F.lit(0.0)).alias("rest"))
        sums = staged(self._partial(placed.filter(~F.col("left_out")), skip_same), "partial-scores")
        again = sums.join(rest, "q_id").join(_kth(sums, k), "q_id", "left")
        enough = again.filter(F.col("partial") + F.col("rest") >= F.greatest(F.col("low"), F.coalesce("bound", F.lit(0.0))) - SLACK).select("q_id", "d_id")
        return rank_hits(self._scored(queries, enough).filter(F.col("score") >= floor), k)

    def _partial(self, terms: DataFrame, skip_same: bool) -> DataFrame:
        """(q_id, d_id, partial): scores from the given terms (q_id, term, weight, blocks) alone."""
        asked = terms.select("q_id", "term", F.col("weight").alias("q_weight"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        met = asked.join(self.lists, ["term", "block"])
        if skip_same:
            met = met.filter("q_id <> d_id")
        return met.groupBy("q_id", "d_id").agg(F.sum(F.col("q_weight") * F.col("weight")).alias("partial"))

    def _scored(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """The pairs with their scores on whole rows."""
        q = queries.select(F.col("id").alias("q_id"), F.inline(_cells("indices", "values"))).withColumnRenamed("weight", "q_weight")
        d = self.rows.select(F.col("id").alias("d_id"), "indices", "values")
        cells = pairs.join(d, "d_id").select("q_id", "d_id", F.inline(_cells("indices", "values")))
        return cells.join(q, ["q_id", "term"]).groupBy("q_id", "d_id").agg(F.round(F.sum(F.col("q_weight") * F.col("weight")), DECIMALS).alias("score"))


def _cells(indices: str, values: str) -> Column:
    return F.transform(F.arrays_zip(indices, values), lambda x: F.struct(x[indices].cast("int").alias("term"), x[values].cast("double").alias("weight")))


def _first(terms: DataFrame, n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy(*order)
    return terms.withColumn("__at", F.row_number().over(w)).filter(F.col("__at") <= n).drop("__at")


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(q_id, bound): the k-th best partial score, of queries with k or more."""
    w = Window.partitionBy("q_id").orderBy(F.desc("partial"))
    best = sums.withColumn("__at", F.row_number().over(w)).filter(F.col("__at") <= k)
    return best.groupBy("q_id").agg(F.min("partial").alias("bound"), F.count("*").alias("__n")).filter(F.col("__n") == k).drop("__n")


def build_postings(rows: DataFrame, block: int = BLOCK_POSTINGS) -> PostingIndex:
    """Index of sparse rows (id, indices, values), staged."""
    rows = staged(rows.select("id", "indices", "values"), "posting-rows")
    lists = rows.select(F.col("id").alias("d_id"), F.inline(_cells("indices", "values"))).filter(F.col("weight") > 0)
    stats = staged(lists.groupBy("term").agg(F.count("*").alias("n"), F.max("weight").alias("most")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "posting-stats")
    blocks = lists.join(stats.select("term", "blocks"), "term").select("term", F.pmod(F.xxhash64("d_id"), "blocks").cast("int").alias("block"), "d_id", "weight")
    return PostingIndex(staged(blocks, "posting-lists"), stats, rows)


def sparse_top_k(queries: DataFrame, corpus: DataFrame, k: int, floor: float = 10.0**-DECIMALS, skip_same: bool = False, block: int = BLOCK_POSTINGS) -> DataFrame:
    """Exact top k of sparse rows on both sides, see `PostingIndex.search`."""
    return build_postings(corpus, block).search(queries, k, floor, skip_same)
