"""Similarity join of shingle sets by several global orders, complete and exact.

Two texts are linked if their sets of word shingles have a Jaccard similarity of at
least `percent` / 100. Put all shingles in any one order: sets that similar share a
shingle among the first few of both (prefix filter). That holds for every order, so a
pair that shares none under one of several orders is no link.

The first order puts rare shingles first, as counted over the whole corpus. Under it
pairs are found: the larger set shows its first n - ceil(s n) + 1 shingles, the smaller
may do with fewer. Only these are shuffled, and only shingles that two sets show go
on. Pairs must pass bounds that cannot lose a link: the sizes, the places of the shared
shingle, and the bits in which two short sketches of the sets differ. The other orders
are orders by hash; under each the pair must share a shingle of both prefixes as well.
What passes all of them is verified on the whole sets.

Only components are wanted, not all links. So texts with equal sets are one node; and in
rounds each shingle's sets are held against one of them, its centre, which hashing
chooses anew in every round, each node trying the centre it has most shingles in common
with. Shingles whose sets are in one component by then are done: a family of near copies
costs a multiple of its size. What is left is compared pair by pair across components. A
shingle that very many sets show is cut into blocks for that, each a join key of its own.

Defined results: words are lower-cased (A-Z) and separated by ASCII white space; a text
of fewer words than a shingle is one shingle; a text without words has an empty set and
is linked with nothing, unless `link_empty` puts all such texts in one component; null
counts as empty; repeated rows are each placed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, temporary_stages
from .common import drop_stage, map_batches, most_frequent, stage, texts
from .components import components
from .registry import query, table

WIDTH = 4
PERCENT = 85
#: Orders a pair must share a prefix shingle under; the first is by rarity.
ORDERS = 3
#: Rounds of comparing with centres at most; how many change the work, not the result.
ROUNDS = 2
#: Sets of one shingle that are one block of a join key.
BLOCK_SETS = 8192
#: Rows of node ids or pairs of them that are broadcast at most (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bits of a sketch for each shingle, of 16,384 bits at most.
SKETCH_BITS = 4
#: Counting cells for each shingle, and the logarithm of most cells; how many frequent ones a task reports, and are kept of all.
CELLS_EACH, CELL_BITS_AT_MOST = 0.25, 24
HEAVY, HEAVIEST = 1 << 16, 1 << 20
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(32)) * _MIX
    return values ^ values >> np.uint64(29)


def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte a random number (one for both cases of a letter, 0 for white space), whether it is part of a word, and a random odd factor for each place in a word."""
    rng = np.random.default_rng(20)
    number = rng.integers(1, 2**63, 256).astype(np.uint64)
    number[65:91] = number[97:123]
    blank = [9, 10, 11, 12, 13, 32]
    number[blank] = 0
    part = np.ones(256, bool)
    part[blank] = False
    return number, part, rng.integers(0, 2**63, 1 << 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _word_numbers(text: bytes, letters: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    number, part, factor = letters
    data = np.frombuffer(text, np.uint8)
    inside = part[data]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if len(inside) and inside[0]:
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return np.empty(0, np.uint64)
    data = data[starts[0] :]
    starts = starts - starts[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    weight = factor[place & 4095]
    if place.max() > 4095:
        weight = weight + (place >> 12).astype(np.uint64) * _FACTOR * np.uint64(2)
    return _mixed(np.add.reduceat(number[data] * weight, starts))


def word_numbers(text: bytes, letters: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, at_once: int = 1 << 20) -> np.ndarray:
    """A 64-bit number for each lower-cased word, in order: hashes of whole stretches of text at a time."""
    letters = letters or _letters()
    if len(text) <= at_once:
        return _word_numbers(text, letters)
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + at_once)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        out.append(_word_numbers(text[start:end], letters))
        start = end
    return np.concatenate(out)


def shingles(text: bytes, width: int = WIDTH, letters: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Sorted distinct numbers of the lower-cased words' shingles; empty without words."""
    hashed = word_numbers(text, letters)
    if not len(hashed):
        return hashed
    width = min(width, len(hashed))
    n = len(hashed) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * _FACTOR + hashed[i : i + n]
    out = _mixed(out)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def common_at_least(n: int, m: int, percent: int) -> int:
    """Shingles that sets of sizes n and m must share to be linked."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    """Of a set of n shingles, how many come first that one must be shared of."""
    return n - -(-percent * n // 100) + 1 if n else 0


def short_prefix(n: int, percent: int) -> int:
    """As `prefix`, if the other set is no smaller."""
    return n - common_at_least(n, n, percent) + 1 if n else 0


def sketch(found: np.ndarray) -> np.ndarray:
    """Bits at the hashes of the shingles, about `SKETCH_BITS` for each; sets whose sketches differ in d bits differ in d shingles at least.

    The length is a power of two, so that a sketch folded in half is the shorter one of the same set.
    """
    size = 64 * (1 << int(np.clip(np.ceil(np.log2(max(1, SKETCH_BITS * len(found) / 64))), 1, 8)))
    bits = np.zeros(size, bool)
    bits[(_mixed(found) >> np.uint64(40)).astype(np.int64) % size] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def by_hash(found: np.ndarray, order: int) -> np.ndarray:
    """The set in the order of the given number, 1 or more."""
    return found[np.argsort(_mixed(found + np.uint64(order * int(_FACTOR) % 2**64)), kind="stable")]


class Rarity:
    """About how often shingles occur, where that is often; 0 for the others."""

    def __init__(self, bits: int, cells: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(cells)
        self.shift, self.cells, self.counts = np.uint64(64 - bits), cells[order], counts[order]

    def order(self, found: np.ndarray) -> np.ndarray:
        """The set with its rare shingles first, by number where counts are equal."""
        if not len(self.cells) or not len(found):
            return found
        cell = (found >> self.shift).astype(np.int64)
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return found[np.argsort(np.where(self.cells[at] == cell, self.counts[at], 0), kind="stable")]


def rarity(rows: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """What `Rarity` is made of: shingles counted over all texts, in cells by hash whose number grows with the texts."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, total) / 7 * CELLS_EACH)), 10, CELL_BITS_AT_MOST))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, letters = np.zeros(1 << bits, np.int32), _letters()
        for batch in batches:
            for text in texts(batch.column(0)):
                np.add.at(counts, (shingles(text, width, letters) >> np.uint64(64 - bits)).astype(np.int64), 1)
        top = np.argpartition(counts, -HEAVY)[-HEAVY:] if len(counts) > HEAVY else np.arange(len(counts))
        top = top[counts[top] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(counts[top].astype(np.int64))], names=["cell", "n"])

    counted = stage(map_batches(rows.select("text"), work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    heavy = most_frequent(counted, "n", HEAVIEST).toArrow()
    drop_stage(counted)
    return bits, heavy.column("cell").to_numpy(), heavy.column("n").to_numpy()


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    """Numbers as a column of lists of longs, without a Python object each."""
    ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
    values = np.concatenate(found) if found else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of some rows each."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _heads(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """`row_id`, `sig` of the set, `n` its size, its sketch `bits`, `first` (its prefix in the order of rarity) and `short`, how much of it is the short prefix."""
    counted = rows.sparkSession.sparkContext.broadcast(rarity(rows, width))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, letters = Rarity(*counted.value), _letters()
        for batch in _parts(batches):
            found = [shingles(t, width, letters) for t in texts(batch.column("text"))]
            sizes = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), pa.array([xxhash.xxh128_digest(f.tobytes()) for f in found], pa.binary()), pa.array(sizes, pa.int64()),
                 _lists([rare.order(f)[: prefix(len(f), percent)] for f in found]), pa.array([short_prefix(n, percent) for n in sizes], pa.int64()), _lists([sketch(f) for f in found])],
                names=["row_id", "sig", "n", "first", "short", "bits"],
            )

    return map_batches(rows.select("row_id", "text"), work, "row_id long, sig binary, n long, first array<long>, short long, bits array<long>")


def _sets(rows: DataFrame, width: int, percent: int, orders: int) -> DataFrame:
    """`node`, `others` (its prefixes in the other orders) and `set`, all its shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in _parts(batches):
            found = [shingles(t, width, letters) for t in texts(batch.column("text"))]
            flat = _lists([by_hash(f, k)[: prefix(len(f), percent)] for f in found for k in range(1, orders)])
            others = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * (orders - 1)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), others, _lists(found)], names=["node", "others", "set"])

    return map_batches(rows.select("row_id", "text"), work, "node long, others array<array<long>>, set array<long>")


def _need(n: Column, m: Column, percent: int) -> Column:
    """Shingles that two sets must share, as a fraction that whole numbers are held against."""
    return percent * (n + m) / (100 + percent) - 1e-6


def _possible(percent: int) -> Column:
    """Bounds on a pair of posts, `x` and `y`, of one shingle: sizes, prefixes, places."""
    n, m, i, j = F.col("x.n"), F.col("y.n"), F.col("x.place"), F.col("y.place")
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    # Of the smaller set (of either, if they are equal) the short prefix does.
    short = F.when(n < m, F.col("x.near")).when(n > m, F.col("y.near")).otherwise(F.col("x.near") & F.col("y.near"))
    places = F.least(i, j) + F.least(n - i, m - j)
    return sizes & short & (places >= _need(n, m, percent))


def _possible_first(percent: int) -> Column:
    """`_possible` of a pair whose first shared shingle this is: nothing that comes before it in either set is shared.

    The order is one for all sets, so a linked pair passes at the first shingle it shares, which both prefixes
    show; it need not pass at the others.
    """
    n, m = F.col("x.n"), F.col("y.n")
    return _possible(percent) & (F.least(n - F.col("x.place"), m - F.col("y.place")) >= _need(n, m, percent))


def _passing(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs `a`, `b` that pass the bound by sketches: twice the shared shingles are n + m less the shingles that one set has alone."""

    def folded(of: str, other: str) -> Column:
        # Sizes of sets that can be linked are so close that their sketches are of one length, or one is twice the other.
        half = F.size(other)
        both = F.zip_with(F.slice(of, 1, half), F.slice(of, half + 1, half), lambda p, q: p.bitwiseOR(q))
        return F.when(F.size(of) > half, both).otherwise(F.col(of))

    one = lambda node, n, b: bits.select(F.col("node").alias(node), F.col("n").alias(n), F.col("bits").alias(b))
    met = pairs.join(one("a", "n", "p"), "a").join(one("b", "m", "q"), "b").select("a", "b", "n", "m", folded("p", "q").alias("p"), folded("q", "p").alias("q"))
    apart = F.aggregate(F.zip_with("p", "q", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, d: total + d)
    return met.where(F.col("n") + F.col("m") - apart >= 2 * _need(F.col("n"), F.col("m"), percent)).select("a", "b")


def _small(df: DataFrame) -> DataFrame:
    """A staged table, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, rows: DataFrame, width: int, percent: int, orders: int) -> DataFrame:
    """The pairs `a`, `b` (staged) that share a prefix shingle under every other order and are linked by their whole sets; staged.

    Sets are made for the texts of these pairs only, and only they are moved.
    """
    if pairs.isEmpty():
        return pairs
    few = _small(pairs)
    nodes = stage(pairs.select(F.col("a").alias("row_id")).union(pairs.select("b")).distinct(), "pair-nodes")
    sets = stage(_sets(rows.join(_small(nodes), "row_id", "left_semi"), width, percent, orders), "sets")
    side = lambda node, as_: sets.join(few, F.col("node") == F.col(node)).select("a", "b", F.col("others").alias(f"{as_}_others"), F.col("set").alias(as_))
    both = side("a", "x").join(side("b", "y"), ["a", "b"])
    under_all = F.forall(F.zip_with("x_others", "y_others", F.arrays_overlap), lambda o: o)
    shared = F.size(F.array_intersect("x", "y"))
    linked = stage(both.where(under_all).where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"), "links-found")
    drop_stage(nodes)
    drop_stage(sets)
    return linked


def _rooted(posts: DataFrame, root: DataFrame | None) -> DataFrame:
    """Posts with the component of their node."""
    if root is None:
        return posts.withColumn("root", F.col("node"))
    return posts.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed_keys(posts: DataFrame) -> DataFrame:
    """Posts, with `root`, of shingles whose sets are in more than one component."""
    mixed = posts.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return posts.join(mixed, "key")


def _with_centres(posts: DataFrame, number: int, percent: int) -> DataFrame:
    """Pairs `a`, `b`: each node with the centre, of another component, that it has most shingles in common with.

    In even rounds a shingle's centre is the set that has least before it, which is the one most like the others: what
    comes before is rarer, as edits are that a copy has alone.
    """
    by = F.xxhash64("key", "node", F.lit(number))
    if number % 2 == 0:
        by = F.struct((F.col("place") / F.col("n")).alias("before"), by.alias("hash"))
    row = F.struct(*[F.col(c) for c in posts.columns if c != "key"])
    centre = posts.groupBy("key").agg(F.min_by(row, by).alias("x"))
    pairs = posts.select("key", row.alias("y")).join(centre, "key").where("x.root <> y.root").where(_possible(percent))
    counted = pairs.groupBy(F.col("y.node").alias("b"), F.col("x.node").alias("a")).count()
    return counted.groupBy("b").agg(F.max_by("a", F.struct("count", F.col("a"))).alias("a")).select("a", "b")


def _all_pairs(posts: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs `a`, `b` of different components that share a shingle and pass the bounds of sizes and places, each once."""
    sized = posts.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    row = F.struct(*[F.col(c) for c in posts.columns if c != "key"])
    cut = posts.select("key", "node", row.alias("y")).join(sized, "key")
    own = cut.select("key", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.col("y").alias("x"))
    all_blocks = cut.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "y")
    pairs = own.join(all_blocks, ["key", "block"]).where("x.node < y.node and x.root <> y.root").where(_possible_first(percent))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _joined(known: DataFrame | None, root: DataFrame | None, pairs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links `a`, `b` that connect what `known` and `new` connect, and the components; staged. What they are made of is deleted."""
    if root is None or not new.isEmpty():
        last, root = known, stage(components(new if known is None else known.union(new)), "roots")
        known = root.select(F.col("node").alias("a"), F.col("root").alias("b"))
        if last is not None:
            drop_stage(last)
    drop_stage(pairs)
    drop_stage(new)
    return known, root


def cluster(rows: DataFrame, width: int = WIDTH, percent: int = PERCENT, orders: int = ORDERS, rounds: int = ROUNDS, block: int = BLOCK_SETS, link_empty: bool = False, start: DataFrame | None = None) -> DataFrame:
    """`row_id`, `n_shingles`, `component` (smallest row id reachable) of every row of `row_id`, `text`.

    `row_id` must stay as it is when `rows` is read again, so it comes from a
    written table. Texts are cut twice; sets are made of those of pairs that
    pass all bounds. `start` has links `a`, `b` of row ids that hold whatever
    the sets are.
    """
    heads = stage(_heads(rows, width, percent), "heads")
    nodes = heads.groupBy("sig").agg(F.min("row_id").alias("node"))
    named = stage(heads.select("row_id", "sig", "n").join(nodes, "sig").select("row_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) | F.lit(link_empty), F.col("node")).otherwise(F.col("row_id")).alias("node")), "named")
    copies = stage(named.where("row_id <> node").select("row_id"), "copies")
    shown = heads.join(_small(copies), "row_id", "left_anti").select(F.col("row_id").alias("node"), "n", "short", F.posexplode("first").alias("place", "key")).select("key", "node", "n", "place", (F.col("place") < F.col("short")).alias("near"))
    shared = shown.groupBy("key").agg(F.count("*").alias("sets"), F.max("near").alias("some")).where("sets > 1 and some").select("key")
    posts = stage(shown.join(shared, "key"), "posts")
    bits = heads.select(F.col("row_id").alias("node"), "n", "bits")
    known, root = None, None
    if start is not None:
        node = lambda row, as_: named.select(F.col("row_id").alias(row), F.col("node").alias(as_))
        known = stage(start.join(node("a", "x"), "a").join(node("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")), "links-known")
    for number in range(rounds):
        rest = stage(_mixed_keys(_rooted(posts, root)), "rest")
        drop_stage(posts)
        posts = rest.drop("root")
        pairs = stage(_passing(_with_centres(rest, number, percent), bits, percent), "centre-pairs")
        known, root = _joined(known, root, pairs, _verified(pairs, rows, width, percent, orders))
    pairs = stage(_passing(_all_pairs(_mixed_keys(_rooted(posts, root)), percent, block), bits, percent), "pairs")
    known, root = _joined(known, root, pairs, _verified(pairs, rows, width, percent, orders))
    for done in [posts, copies, heads]:
        drop_stage(done)
    return named.join(root, "node", "left").select("row_id", "n_shingles", F.coalesce("root", "node").alias("component"))


def similar(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, orders: int = ORDERS, rounds: int = ROUNDS, block: int = BLOCK_SETS) -> DataFrame:
    """`id`, `n_shingles` and `component_id`, the smallest id reachable by links, of every row.

    A null id is kept; its component is the smallest id reachable, null only if there is none.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "placed")
    with temporary_stages(spark):  # all but the result
        rows = stage(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "texts")
        placed = stage(cluster(rows.select("row_id", "text"), width, percent, orders, rounds, block).join(rows.select("row_id", "id"), "row_id"), "placed", path)
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    return placed.join(least, "component").select("id", "n_shingles", "component_id")


_SQL = r"""
with recursive lowered as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') ws from documents),
places as (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) i from lowered where len(ws) > 0),
sets as (select distinct doc_id, array_to_string(ws[i : i + 3], ' ') s from places),
sizes as (select doc_id, count(*) n from sets group by doc_id),
numbers as (select s, row_number() over () k from (select s from sets group by s having count(*) > 1)),
shared as (select doc_id, k from sets join numbers using (s)),
links as (select p.a, p.b from (select x.doc_id a, y.doc_id b, count(*) c from shared x join shared y on x.k = y.k and x.doc_id < y.doc_id group by all) p join sizes m on m.doc_id = a join sizes n on n.doc_id = b where 100 * c >= 85 * (m.n + n.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a)
select d.doc_id, coalesce(n, 0) n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) component_id
from documents d left join sizes on sizes.doc_id = d.doc_id left join (select a, min(b) low from reach group by a) r on r.a = d.doc_id
"""


@query("op12_jaccard_join", _SQL)
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return similar(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
