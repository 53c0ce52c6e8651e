"""Top-k by inner product between two tables of vectors.

No row pair is ever written out: matrix blocks are multiplied inside Arrow
batches and each task emits only the best k documents per query it saw. Queries
up to a checked size are sent to the documents, which stay where they are. Beyond
it both sides are dealt out to slots by one shuffle: in a slot a part of the
documents of bounded size is held, and queries stream by, so each is done with
when it has passed and nothing is kept for it.

Scores are rounded to nine decimals so that ties break by document id and not by
the order floating-point sums happened to run in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import BROADCAST_BYTES, SEED
from ..functions.vectors import norm, normalise
from ..session import staged

HIT = "q_id bigint, d_id bigint, score double"
DECIMALS = 9
BLOCK = 2048
#: Documents of a cell that are one part of it, where queries are sent to cells by a join.
CELL_PART_ROWS = 100_000
#: Documents of a part held by a slot, in bytes of doubles.
HELD_BYTES = 32 * 1024 * 1024
#: The same of sparse rows, whose cells are counted with twelve bytes.
SPARSE_HELD_BYTES = 64 * 1024 * 1024
#: Queries of a part of a cell's queries: they stream by, so this only spreads work over tasks.
QUERY_PART_ROWS = 1 << 17
#: Queries that are sent to every task: each of an executor's Python processes holds them and their best k.
SENT_BYTES = 4 * 1024 * 1024


def _matrix(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    """Dense rows from either a `vector` column or `indices`/`values` columns."""
    if "vector" in pdf.columns:
        return np.array(pdf["vector"].tolist(), dtype=np.float64).reshape(len(pdf), dim)
    out = np.zeros((len(pdf), dim))
    if len(pdf):
        rows = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["indices"]])
        out[rows, np.concatenate(pdf["indices"].tolist()).astype(np.int64)] = np.concatenate(pdf["values"].tolist())
    return out


def _trim(q: np.ndarray, d: np.ndarray, s: np.ndarray, k: int):
    """Best k per query, by score then document id."""
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    first = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.array([], dtype=int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    keep = rank < k
    return q[keep], d[keep], s[keep]


def _block_top_k(q_ids, qm, d_ids, dm, k: int, skip_same: bool, floor: float | None):
    """Best k documents of one block for every query of one block."""
    scores = np.round(qm @ dm.T, DECIMALS)
    if skip_same:
        scores[q_ids[:, None] == d_ids[None, :]] = -np.inf
    low = -np.inf if floor is None else floor
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        keep = scores >= np.maximum(kth, low)[:, None]
    else:
        keep = scores >= low
    keep &= scores > -np.inf
    rows, cols = np.nonzero(keep)
    return _trim(q_ids[rows], d_ids[cols], scores[rows, cols], k)


def _held_top_k(q_ids, qm, d_ids, dm, k: int, skip_same: bool, floor: float | None):
    """Best k of the held documents, which are in order of id, for every query of one block.

    Once a query has k documents, a later one has to beat the k-th: of equal scores the
    smaller id stays. So most blocks are one product and one comparison.
    """
    low = np.finfo(np.float64).min if floor is None else floor
    half = 0.5 * 10.0**-DECIMALS
    bar = np.full(len(q_ids), low - 2 * half if floor is not None else low)
    q, d, s = np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([])
    at, step = 0, max(256, 4 * k)  # few at first, as every document of the first block is better than none
    while at < len(d_ids):
        ids = d_ids[at : at + step]
        scores = qm @ dm[at : at + step].T
        if skip_same:
            first, last = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
            for more in range(int((last - first).max(initial=0))):
                own = np.flatnonzero(first + more < last)
                scores[own, first[own] + more] = -np.inf
        rows, cols = np.nonzero(scores >= bar[:, None])
        at, step = at + step, BLOCK
        if not len(rows):
            continue
        new = np.round(scores[rows, cols], DECIMALS)
        good = new >= low
        q, d, s = _trim(np.concatenate([q, rows[good]]), np.concatenate([d, ids[cols[good]]]), np.concatenate([s, new[good]]), k)
        n = np.bincount(q, minlength=len(q_ids))
        full = np.flatnonzero(n == k)
        kth = s[np.cumsum(n)[full] - 1]
        bar[full] = kth + half - 1e-12 * (1 + np.abs(kth))
    return q_ids[q], d, s


class _Best:
    """Running best k per query over many blocks, kept by slice of queries.

    A block touches the list of its own slice only.
    """

    def __init__(self, k: int):
        self.k = k
        self.parts: dict = {}

    def add(self, slot, part) -> None:
        old = self.parts.get(slot)
        self.parts[slot] = part if old is None else _trim(*[np.concatenate(p) for p in zip(old, part)], self.k)

    def frame(self) -> pd.DataFrame:
        none = (np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([]))
        columns = [np.concatenate(p) for p in zip(none, *self.parts.values())]
        # a query met in several slots still gets its k best alone
        return pd.DataFrame(dict(zip(("q_id", "d_id", "score"), _trim(*columns, self.k))))


def _slices(n: int, size: int) -> Iterator[slice]:
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def _block_rows(dim: int) -> int:
    return max(64, min(BLOCK, (1 << 22) // max(dim, 1)))


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """Global top k per query with ranks 1..k."""
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "d_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _columns(df: DataFrame) -> list[str]:
    return ["id", "vector"] if "vector" in df.columns else ["id", "indices", "values"]


def _usable(df: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector can be compared; sparse rows come from the library itself."""
    if "vector" not in df.columns:
        return df
    v = F.col("vector")
    return df.filter(v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))


def _bytes(df: DataFrame, dim: int) -> int:
    """Bytes of a vector table, counted without moving it."""
    if "vector" in df.columns:
        return df.count() * (dim * 8 + 8)
    n, cells = df.agg(F.count("*"), F.coalesce(F.sum(F.size("indices")), F.lit(0))).first()
    return cells * 12 + n * 8


def exact_top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    dim: int,
    skip_same: bool = False,
    floor: float | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact top k documents per query: (q_id, d_id, score, rank).

    Both tables have `id` and either `vector` or sparse `indices`/`values`.
    `skip_same` leaves out a document with the query's own id, `floor` drops
    scores below it. Queries of at most `broadcast_bytes`, and of vectors `SENT_BYTES`, are sent
    to the documents; more of them meet the documents in a grid. Rows without a usable vector
    (null, wrong length, null or NaN cells) take no part on either side.
    """
    # renamed copies: both sides may be the same table
    queries = queries.select(*_columns(queries)).toDF(*_columns(queries))
    corpus = corpus.select(*_columns(corpus)).toDF(*_columns(corpus))
    queries, corpus = _usable(queries, dim), _usable(corpus, dim)
    size, dense = _bytes(queries, dim), "vector" in queries.columns
    if size <= (min(broadcast_bytes, SENT_BYTES) if dense else broadcast_bytes):
        hits = _send_queries(queries, corpus, k, dim, skip_same, floor)
    elif dense:
        hits = _pass_by(*held_grid(queries, corpus, _bytes(corpus, dim)), k, dim, skip_same, floor)
    else:
        hits = _meet(*grid(queries, corpus, size, broadcast_bytes), k, dim, skip_same, floor)
    return rank_hits(hits, k)


def _send_queries(queries, corpus, k, dim, skip_same, floor) -> DataFrame:
    sent = corpus.sparkSession.sparkContext.broadcast(queries.toPandas())  # size was checked by the caller
    step = _block_rows(dim)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = sent.value
        best = _Best(k)
        q_ids = q["id"].to_numpy(np.int64)
        for batch in batches:
            ids = batch["id"].to_numpy(np.int64)
            for d in _slices(len(batch), step):
                dm = _matrix(batch.iloc[d], dim)
                for s in _slices(len(q), step):
                    best.add(s.start, _block_top_k(q_ids[s], _matrix(q.iloc[s], dim), ids[d], dm, k, skip_same, floor))
        yield best.frame()

    return corpus.mapInPandas(search, HIT)


def held_grid(queries: DataFrame, corpus: DataFrame, size: int, held_bytes: int = HELD_BYTES, slots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with the `slot` each row goes to: documents, of `size` bytes, in parts of `held_bytes`, each to be passed by all queries.

    A query is copied to every part. Only if these are fewer than `slots` (by default two for
    each core) are queries dealt out too, and a part copied to each share of them.
    """
    slots = slots or 2 * queries.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-size // held_bytes))
    shares = max(1, -(-slots // parts))
    share, part = F.pmod(F.xxhash64("id"), F.lit(shares)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts))
    asked = queries.withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: p * shares + share)))
    held = corpus.withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0), F.lit(shares - 1)), lambda q: part * shares + q)))
    return asked, held


def _pass_by(asked: DataFrame, held: DataFrame, k: int, dim: int, skip_same: bool, floor: float | None = None) -> DataFrame:
    """Best k per slot and query of the documents of the same `slot`; one shuffle of both sides.

    A slot's documents come first and are held, so the caller bounds them; queries stream by.
    """
    kind = "float" if all("float" in df.schema["vector"].dataType.simpleString() for df in (asked, held)) else "double"
    as_rows = lambda df, side: df.select(F.col("slot").cast("bigint").alias("slot"), F.lit(side).alias("side"), F.col("id").cast("bigint").alias("id"), F.col("vector").cast(f"array<{kind}>").alias("vector"))
    both = as_rows(held, 0).unionByName(as_rows(asked, 1)).repartition("slot").sortWithinPartitions("slot", "side", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts, found = None, [], None
        for batch in batches:
            slots, sides, ids = (batch.column(c).to_numpy() for c in ("slot", "side", "id"))
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
            ends = np.flatnonzero((slots[1:] != slots[:-1]) | (sides[1:] != sides[:-1])) + 1
            for lo, hi in zip(np.r_[0, ends], np.r_[ends, len(ids)]):
                if hi == lo:
                    continue
                if slots[lo] != slot:
                    slot, parts, found = slots[lo], [], None
                if sides[lo] == 0:
                    parts.append((ids[lo:hi].copy(), vectors[lo:hi].copy()))
                    continue
                if found is None:
                    if not parts:
                        continue
                    found = [np.concatenate(p) for p in zip(*parts)]
                    found[1], parts = found[1].astype(np.float64), []
                for s in _slices(hi - lo, BLOCK):
                    block = slice(lo + s.start, lo + s.stop)
                    q, d, score = _held_top_k(ids[block], vectors[block].astype(np.float64), *found, k, skip_same, floor)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(d), pa.array(score)], names=["q_id", "d_id", "score"])

    return both.mapInArrow(search, HIT)


#: Terms whose posting lists are the longest are held as dense rows of single precision, at most so many, where a list has one row in `DENSE_SHARE`.
DENSE_TERMS, DENSE_SHARE = 256, 100
#: Approximate scores that are made at once.
DENSE_SCORES = 1 << 23
#: What a product of so many single-precision terms may be off by, in lengths of both rows.
DENSE_ERROR = 4e-5


@dataclass
class _Posted:
    """Held rows in order of id: by row, and by term as posting lists (rows and weights from `starts[term]` to `starts[term + 1]`)."""

    ids: np.ndarray
    row_starts: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    column: np.ndarray  # [term] its place in `dense`, or -1
    dense: np.ndarray
    longest: float

    @classmethod
    def of(cls, ids, lengths, idx, val, dim: int) -> "_Posted":
        row = np.repeat(np.arange(len(ids)), lengths)
        n = np.bincount(idx, minlength=dim)
        often = np.argsort(-n, kind="stable")[:DENSE_TERMS]
        often = often[n[often] * DENSE_SHARE > len(ids)]
        column = np.full(dim, -1)
        column[often] = np.arange(len(often))
        dense, is_dense = np.zeros((len(often), len(ids)), np.float32), column[idx] >= 0
        dense[column[idx[is_dense]], row[is_dense]] = val[is_dense]
        left = np.flatnonzero(~is_dense)
        left = left[np.argsort(idx[left], kind="stable")]
        starts = np.searchsorted(idx[left], np.arange(dim + 1))
        longest = np.sqrt(np.bincount(row, val * val, len(ids)).max(initial=0))
        return cls(ids, np.r_[0, np.cumsum(lengths)], idx, val, starts, row[left], val[left], column, dense, longest)

    def dense_sums(self, lengths, idx, val) -> np.ndarray:
        """[query, row] what the dense terms add, in single precision."""
        queries = np.zeros((len(lengths), len(self.dense)), np.float32)
        at = self.column[idx]
        queries[np.repeat(np.arange(len(lengths)), lengths)[at >= 0], at[at >= 0]] = val[at >= 0]
        return queries @ self.dense

    def sums(self, idx, val) -> np.ndarray:
        """Of each row what the other terms add, by their posting lists."""
        other = self.column[idx] < 0
        first, last = self.starts[idx[other]], self.starts[idx[other] + 1]
        lists = list(map(slice, first.tolist(), last.tolist()))
        if not lists:
            return np.zeros(len(self.ids))
        given = np.concatenate([self.weights[x] for x in lists]) * np.repeat(val[other], last - first)
        return np.bincount(np.concatenate([self.rows[x] for x in lists]), given, len(self.ids)).astype(np.float64)  # whole numbers if there is nothing to add

    def products(self, at, idx, val) -> np.ndarray:
        """Of some rows their product with a whole query, rounded."""
        query = np.zeros(len(self.column))
        query[idx] = val
        n = self.row_starts[at + 1] - self.row_starts[at]
        cells = np.repeat(self.row_starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.round(np.bincount(np.repeat(np.arange(len(at)), n), query[self.idx[cells]] * self.val[cells], len(at)).astype(np.float64), DECIMALS)


def _posted_top_k(q_id, idx, val, dense, held: _Posted, k: int, skip_same: bool, floor: float):
    """Best k of the held rows for one sparse query: (d_id, score), best first.

    Rows whose sum is so near to the k-th that single precision may hide their place are scored anew.
    """
    ids = held.ids
    if not len(idx):
        return ids[:0], val[:0]
    sums = held.sums(idx, val) + dense
    if skip_same:
        sums[np.searchsorted(ids, q_id, "left") : np.searchsorted(ids, q_id, "right")] = -np.inf
    slack = DENSE_ERROR * np.sqrt(val @ val) * held.longest + 10.0**-DECIMALS
    kth = -np.inf if len(ids) <= k else np.partition(sums, len(sums) - k)[len(sums) - k]
    at = np.flatnonzero((sums >= max(floor - slack, kth - 2 * slack)) & (sums != 0) & (sums > -np.inf))
    scores = held.products(at, idx, val)
    best = np.flatnonzero(scores >= floor)
    best = best[np.argsort(-scores[best], kind="stable")[:k]]  # of equal scores the smaller id first
    return ids[at[best]], scores[best]


def _pass_by_sparse(asked: DataFrame, held: DataFrame, k: int, dim: int, skip_same: bool, floor: float) -> DataFrame:
    """As `_pass_by`, of sparse rows: a slot holds its documents as posting lists, in which each query's terms are looked up."""
    as_rows = lambda df, side: df.select(F.col("slot").cast("bigint").alias("slot"), F.lit(side).alias("side"), F.col("id").cast("bigint").alias("id"), F.col("indices").cast("array<int>").alias("indices"), F.col("values").cast("array<double>").alias("values"))
    both = as_rows(held, 0).unionByName(as_rows(asked, 1)).repartition("slot").sortWithinPartitions("slot", "side", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts, found = None, [], None
        for batch in batches:
            slots, sides, ids = (batch.column(c).to_numpy() for c in ("slot", "side", "id"))
            lengths = pc.fill_null(pc.list_value_length(batch.column("indices")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.r_[0, np.cumsum(lengths)]
            idx, val = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("indices", "values"))
            ends = np.flatnonzero((slots[1:] != slots[:-1]) | (sides[1:] != sides[:-1])) + 1
            best = []
            for lo, hi in zip(np.r_[0, ends], np.r_[ends, len(ids)]):
                if hi == lo:
                    continue
                if slots[lo] != slot:
                    slot, parts, found = slots[lo], [], None
                if sides[lo] == 0:
                    cells = slice(at[lo], at[hi])
                    parts.append((ids[lo:hi].copy(), lengths[lo:hi].copy(), idx[cells].copy(), val[cells].copy()))
                    continue
                if found is None:
                    if not parts:
                        continue
                    found, parts = _Posted.of(*[np.concatenate(p) for p in zip(*parts)], dim), []
                for block in _slices(hi - lo, max(1, min(BLOCK, DENSE_SCORES // max(1, len(found.ids))))):
                    first, last = lo + block.start, lo + block.stop
                    dense = found.dense_sums(lengths[first:last], idx[at[first] : at[last]], val[at[first] : at[last]])
                    for i in range(first, last):
                        d, score = _posted_top_k(ids[i], idx[at[i] : at[i + 1]], val[at[i] : at[i + 1]], dense[i - first], found, k, skip_same, floor)
                        best.append((np.full(len(d), ids[i]), d, score))
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*best)], names=["q_id", "d_id", "score"])

    return both.mapInArrow(search, HIT)


def sparse_top_k_held(queries: DataFrame, corpus: DataFrame, k: int, dim: int, floor: float = 10.0**-DECIMALS, skip_same: bool = False, held_bytes: int = SPARSE_HELD_BYTES) -> DataFrame:
    """Exact top k of sparse rows over `dim` terms, whose values are not negative: (q_id, d_id, score, rank), of documents with a score of `floor` or more, which is above zero.

    No pair leaves a task: what is shuffled are the documents, the queries once for each part of
    the documents, and k results for each of those.
    """
    queries, corpus = (staged(df.select("id", "indices", "values"), name) for df, name in ((queries, "query-rows"), (corpus, "document-rows")))
    return rank_hits(_pass_by_sparse(*held_grid(queries, corpus, _bytes(corpus, dim), held_bytes), k, dim, skip_same, floor), k)


def grid(queries: DataFrame, corpus: DataFrame, size: int, block_bytes: int, slots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with the `slot` each row goes to, in a grid of as many rows of slots as the queries are blocks of `block_bytes`.

    There are `slots` slots at least (by default two for each core); what queries do not need
    goes to cutting the documents. A query is copied to all columns of its row, a document to
    all rows of its column, so every pair meets once.
    """
    slots = slots or 2 * queries.sparkSession.sparkContext.defaultParallelism
    rows = max(-(-size // max(block_bytes, 1)), round(slots**0.5))
    columns = max(1, -(-slots // rows))
    row, column = F.pmod(F.xxhash64("id"), F.lit(rows)), F.pmod(F.xxhash64("id"), F.lit(columns))
    asked = queries.withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: row * columns + c)))
    held = corpus.withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * columns + column)))
    return asked, held


def _meet(asked: DataFrame, held: DataFrame, k: int, dim: int, skip_same: bool, floor: float | None = None) -> DataFrame:
    """Best k per slot and query of the documents of the same `slot`; one shuffle of both sides.

    A slot's queries come first and are held, so the caller bounds them; documents stream by.
    """
    columns = _columns(asked)
    as_rows = lambda df, side: df.select("slot", F.lit(side).alias("side"), "id", *[F.col(c).cast(f"array<{'int' if c == 'indices' else 'double'}>").alias(c) for c in columns[1:]])
    both = as_rows(asked, 0).unionByName(as_rows(held, 1)).repartition("slot").sortWithinPartitions("slot", "side")
    step = _block_rows(dim)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, parts, blocks, best = None, [], None, _Best(k)
        for batch in batches:
            for (at, side), part in batch.groupby(["slot", "side"], sort=True):
                if at != slot:
                    yield best.frame()
                    slot, parts, blocks, best = at, [], None, _Best(k)
                if side == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if blocks is None:
                    q = pd.concat(parts, ignore_index=True)
                    blocks = [(s.start, q["id"].to_numpy(np.int64)[s], _matrix(q.iloc[s], dim)) for s in _slices(len(q), step)]
                for d in _slices(len(part), step):
                    ids, dm = part["id"].to_numpy(np.int64)[d], _matrix(part.iloc[d], dim)
                    for start, q_ids, qm in blocks:
                        best.add(start, _block_top_k(q_ids, qm, ids, dm, k, skip_same, floor))
        yield best.frame()

    return both.mapInPandas(search, HIT)


@dataclass
class CellIndex:
    """Documents assigned to cells by inner product with unit centroids.

    Their number was chosen by the caller; centroids are held by the driver.
    """

    centroids: np.ndarray
    documents: DataFrame  # id, vector, cell

    def save(self, path: str) -> None:
        """Documents laid out by cell, each cell in a few files, so a search reads the cells it probes."""
        spark = self.documents.sparkSession
        self.documents.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/documents")
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CellIndex":
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        return cls(np.array([r["centroid"] for r in rows]), spark.read.parquet(f"{path}/documents"))

    def search(self, queries: DataFrame, k: int, probe: int, skip_same: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Approximate top k: exact scores inside the `probe` cells nearest to each query.

        With as many cells probed as there are, the search is exact and cells are not kept
        apart, so a query is not copied to each of them. Cells that no query probes are not read.
        Queries of more than `broadcast_bytes` or `SENT_BYTES` go to their cells by a join.
        """
        dim = self.centroids.shape[1]
        if probe >= len(self.centroids):
            return exact_top_k(queries, self.documents, k, dim, skip_same, broadcast_bytes=broadcast_bytes)
        queries = _usable(queries.select("id", "vector"), dim)
        size = _bytes(queries, dim)
        if size <= min(broadcast_bytes, SENT_BYTES):
            return rank_hits(self._scan(queries, k, probe, skip_same), k)
        return rank_hits(_pass_by(*self._sent_to_cells(queries, probe), k, dim, skip_same), k)

    def _sent_to_cells(self, queries: DataFrame, probe: int, query_rows: int = QUERY_PART_ROWS, part_rows: int = CELL_PART_ROWS) -> tuple[DataFrame, DataFrame]:
        """Queries copied to the cells they probe, and the documents of these cells, both with the `slot` they meet in.

        A slot is a part of a cell's documents and a part of the queries sent to it: a large cell
        is cut into parts of about `part_rows` documents, and the queries of a cell into parts of
        about `query_rows`, so neither a hot cell nor one that many queries probe is one task.
        """
        centroids = queries.sparkSession.sparkContext.broadcast(self.centroids)
        dim = self.centroids.shape[1]
        kind = queries.schema["vector"].dataType.simpleString()

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                near = np.argsort(-(_matrix(b, dim) @ centroids.value.T), axis=1, kind="stable")[:, :probe]
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(np.int64), near.shape[1]), "vector": b["vector"].repeat(near.shape[1]).to_numpy(), "cell": near.ravel().astype(np.int32)})

        sent = staged(queries.mapInPandas(nearest, f"id bigint, vector {kind}, cell int"), "sent-to-cells")
        asked = sent.groupBy("cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("q_parts"))
        # One row for each cell of the index, so these are collected: cells that nobody probes are not read.
        probed = {r["cell"]: r["q_parts"] for r in asked.collect()}
        held = self.documents.filter(F.col("cell").isin(sorted(probed)))
        sizes = asked.join(held.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("d_parts")), "cell")
        slot = lambda d, q: F.xxhash64(F.col("cell"), d, q)
        part = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
        copies = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        q = sent.join(F.broadcast(sizes), "cell").withColumn("d_part", copies("d_parts")).withColumn("slot", slot(F.col("d_part"), part("q_parts")))
        d = held.join(F.broadcast(sizes), "cell").withColumn("q_part", copies("q_parts")).withColumn("slot", slot(part("d_parts"), F.col("q_part")))
        return q.select("id", "vector", "slot"), d.select("id", "vector", "slot")

    def _scan(self, queries: DataFrame, k: int, probe: int, skip_same: bool) -> DataFrame:
        dim = self.centroids.shape[1]
        step = _block_rows(dim)
        q = queries.toPandas()  # size was checked by the caller
        qm, q_ids = _matrix(q, dim), q["id"].to_numpy(np.int64)
        near = np.argsort(-(qm @ self.centroids.T), axis=1, kind="stable")[:, :probe]
        sent = queries.sparkSession.sparkContext.broadcast((qm, q_ids, near))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qm, q_ids, near = sent.value
            best = _Best(k)
            for batch in batches:
                for cell, part in batch.groupby("cell"):
                    wanted = np.flatnonzero((near == cell).any(axis=1))
                    ids = part["id"].to_numpy(np.int64)
                    for d in _slices(len(part), step):
                        dm = _matrix(part.iloc[d], dim)
                        for s in _slices(len(wanted), step):
                            rows = wanted[s]
                            best.add((cell, s.start), _block_top_k(q_ids[rows], qm[rows], ids[d], dm, k, skip_same, None))
            yield best.frame()

        probed = [int(c) for c in np.unique(near)]
        return self.documents.filter(F.col("cell").isin(probed)).mapInPandas(scan, HIT)


def build_cells(corpus: DataFrame, cells: int, seed: int = SEED, max_iter: int = 10) -> CellIndex:
    """Index with `cells` cells by k-means over unit vectors.

    Zero vectors have no direction to learn from; they are assigned like all
    others. Rows without a vector, or with null or NaN cells, are left out.
    """
    v = F.col("vector")
    corpus = corpus.filter(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    unit = corpus.filter(norm(v) > 0).select(array_to_vector(normalise(v)).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, featuresCol="features", distanceMeasure="cosine").fit(unit)
    centroids = np.array(model.clusterCenters())
    centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-300)
    dim = centroids.shape[1]
    kind = corpus.schema["vector"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell = np.argmax(_matrix(b, dim) @ centroids.T, axis=1) if len(b) else np.array([], dtype=int)
            yield b.assign(cell=cell.astype(np.int32))

    documents = _usable(corpus, dim).select("id", "vector").mapInPandas(assign, f"id bigint, vector {kind}, cell int")
    return CellIndex(centroids, staged(documents, "cells"))  # read by every search


def top_k(queries: DataFrame, corpus: DataFrame, k: int, dim: int, index: CellIndex | None = None, probe: int = 10, skip_same: bool = False) -> DataFrame:
    """Exact search, or a search of `probe` cells when an index is given; never chosen by size."""
    if index is None:
        return exact_top_k(queries, corpus, k, dim, skip_same)
    return index.search(queries, k, probe, skip_same)
