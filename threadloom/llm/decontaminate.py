"""Benchmark decontamination: close word pairs as seeds, then Smith-Waterman alignment.

A test item is looked for by close pairs: two of its words that have at most one
word between them in the item and at most one in the document. In a passage that
scores `min_score` of a full copy of L words, at least min_score * L - 1 pairs of
matched words that follow each other are close, because every other such pair
costs two edits or more. So of an item's pairs the most frequent in the corpus
may be left out, up to half of that number, and a passage still holds the rest
of it (`needed`); nothing that can reach the threshold is missed, whatever words
were replaced, put in or taken out. Around such hits a stretch of the document
is aligned with the item, word by word, and the local alignment's score as a
share of a full copy's decides, so edited and paraphrased copies count by what
they keep.

A stretch is not aligned only if it holds too few words of the item to reach
the threshold at best, which changes no result.

The benchmark is the query set: it is taken in blocks of about `BLOCK_BYTES`,
each broadcast and held against all documents. Documents stay where they are and
are read whole; what is shuffled are counts of the benchmark's own n-grams.

Defined results: words are runs of letters, digits and underscores, in lower
case; a null text counts as empty; documents or items without words never match;
an item of one or two words is its own seed; equal items are all
reported; repeated documents are each reported; ids may be null; other columns
pass through untouched whatever their names; empty tables give empty results,
and an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches
from .registry import query, table

#: Items of fewer words are their own seed; key code of close pairs.
PAIRS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of a full copy's score from which a passage counts as a leak.
MIN_SCORE = 0.4
BLOCK_BYTES = 8 << 20
WORD = re.compile(r"\w+")




def _lowered() -> bytes:
    """For each byte of code page 1252 the lower-cased letter, or a blank for what is in no word."""
    chars = bytes(range(256)).decode("cp1252", "replace")
    return b"".join(c.lower().encode("cp1252") if c != "\ufffd" and WORD.match(c) else b" " for c in chars)


_LOWERED = _lowered()


def words_of(text: str | None) -> list[str]:
    """Lower-cased words. Texts of one-byte characters are lower-cased and cut as a whole, with the same words."""
    text = text or ""
    try:
        return text.encode("cp1252").translate(_LOWERED).decode("cp1252").split()
    except UnicodeEncodeError:
        return [w.lower() for w in WORD.findall(text)]


@dataclass
class Items:
    """A block of the benchmark: items as word numbers (from 1; 0 is any other word)."""

    ids: list[int | None]
    vocabulary: dict[str, int]
    words: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Items:
        vocabulary: dict[str, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(t)], np.int64) for _, t in rows]
        return cls([i for i, _ in rows], vocabulary, words)

    def width(self, item: int) -> int:
        """Words of the item's own seed, or `PAIRS`."""
        return min(PAIRS, len(self.words[item]))

    def keys(self, seen: np.ndarray, width: int) -> np.ndarray:
        """One number for each n-gram, -1 where a word is not in the vocabulary; of close pairs those without a word between come first, then those with one."""
        size = len(self.vocabulary) + 1
        if width == PAIRS:
            one, two = np.concatenate([seen[:-1], seen[:-2]]), np.concatenate([seen[1:], seen[2:]])
            return np.where((one > 0) & (two > 0), (one * size + two) * 4 + width, -1)
        n = len(seen) - width + 1
        if n <= 0:
            return np.empty(0, np.int64)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(width):
            key = key * size + seen[i : i + n]
            known &= seen[i : i + n] > 0
        return np.where(known, key * 4 + width, -1)

    def numbers(self, text: str | None) -> np.ndarray:
        found = words_of(text)
        return np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the place after its last word in the stretch."""
    row = np.zeros(len(stretch) + 1, np.int64)
    steps = -GAP * np.arange(len(stretch) + 1)
    best, end = 0, 0
    for word in item:
        above = np.maximum(row + GAP, 0)
        above[1:] = np.maximum(above[1:], row[:-1] + np.where(stretch == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(above + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def _lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `keys` that are among the sorted ones, and where."""
    if not len(sorted_keys) or not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    known = np.flatnonzero(keys >= 0)
    keys = keys[known]
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    same = np.flatnonzero(sorted_keys[at] == keys)
    return known[same], at[same]


def count_grams(docs: DataFrame, items, grams, text: str) -> dict[int, int]:
    """Occurrences in all documents of the block's own n-grams."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys = Items(*items.value), grams.value
        widths = sorted({int(k) & 3 for k in keys})
        counts = np.zeros(len(keys), np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen = block.numbers(value)
                for width in widths:
                    _, at = _lookup(keys, block.keys(seen, width))
                    np.add.at(counts, at, 1)
        some = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(counts[some])], names=["gram", "n"])

    counted = map_batches(docs.select(F.col(text).cast("string").alias("text")), work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return dict(counted.collect())


def _starts(words: int) -> np.ndarray:
    """The first word of each close pair, in the order of their keys."""
    return np.concatenate([np.arange(max(0, words - 1)), np.arange(max(0, words - 2))])


def seeds_of(block: Items, counts: dict[int, int], min_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted seed keys; for each its range in two arrays of items and offsets; how many offsets each item needs."""
    chosen: dict[int, set[tuple[int, int]]] = {}
    needed = np.ones(len(block.words), np.int64)
    for item, words in enumerate(block.words):
        if not len(words):
            continue
        width = block.width(item)
        keys = block.keys(words, width).tolist()
        starts = _starts(len(words)) if width == PAIRS else np.zeros(len(keys), np.int64)
        left_out: set[int] = set()
        if width == PAIRS:
            close = max(1, int(np.ceil(min_score * len(words) - 1 - 1e-9)))
            often = np.zeros(len(words) - 1, np.int64)
            np.maximum.at(often, starts, [counts.get(k, 0) for k in keys])
            left_out = set(np.argsort(-often, kind="stable")[: close // 2].tolist())
            needed[item] = close - close // 2
        for k, at in zip(keys, starts.tolist()):
            if at not in left_out:
                chosen.setdefault(k, set()).add((item, at))
    order = sorted(chosen)
    postings = [sorted(chosen[k]) for k in order]
    ends = np.cumsum([0] + [len(p) for p in postings])
    flat = np.array([x for p in postings for x in p], np.int64).reshape(-1, 2)
    return np.array(order, np.int64), ends, flat[:, 0], flat[:, 1], needed


def _hits(seen: np.ndarray, block: Items, seeds: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, offset and place of the hits of all items that have as many different offsets as they need."""
    keys, ends, of_item, of_offset, needed = seeds
    items, offsets, places = [], [], []
    for width in sorted({int(k) for k in np.unique(keys & 3)}):
        at, k = _lookup(keys, block.keys(seen, width))
        at = _starts(len(seen))[at] if width == PAIRS else at
        n = ends[k + 1] - ends[k]
        posting = np.repeat(ends[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        items.append(of_item[posting])
        offsets.append(of_offset[posting])
        places.append(np.repeat(at, n))
    item, offset, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (items, offsets, places))
    if not len(item):
        return item, offset, place
    longest = int(offset.max()) + 1
    found = np.bincount(np.unique(item * longest + offset) // longest, minlength=len(needed))
    enough = found[item] >= needed[item]
    return item[enough], offset[enough], place[enough]


def leaks_in(text: str | None, block: Items, seeds: tuple, min_score: float) -> list[dict]:
    """Items leaked into one text: best score and the span of the passage in code points."""
    seen = block.numbers(text)
    needed = seeds[4]
    item_of, offset_of, place_of = _hits(seen, block, seeds)
    order = np.lexsort((place_of - offset_of, item_of))
    item_of, offset_of, place_of = item_of[order], offset_of[order], place_of[order]
    found, spans = [], None
    cuts = np.nonzero(np.diff(item_of))[0] + 1
    for part in np.split(np.arange(len(item_of)), cuts) if len(item_of) else []:
        item = int(item_of[part[0]])
        words = block.words[item]
        least = min_score * MATCH * len(words)
        # A passage that reaches the threshold holds so many words more than the item, or fewer, at most.
        slack = int(MATCH * len(words) - least) + 2
        own = np.unique(words)
        best, span = 0, (0, 0)
        diagonal = place_of[part] - offset_of[part]
        for near in np.split(part, np.nonzero(np.diff(diagonal) > 2 * slack)[0] + 1):
            if len(np.unique(offset_of[near])) < needed[item]:
                continue
            lo = max(0, int(place_of[near[0]] - offset_of[near[0]]) - slack)
            stretch = seen[lo : int(place_of[near[-1]] - offset_of[near[-1]]) + len(words) + slack]
            if MATCH * np.isin(stretch, own).sum() < max(least, best + 1):
                continue
            score, end = align(words, stretch)
            if score > best and score >= least:
                _, back = align(words[::-1], stretch[:end][::-1])
                best, span = score, (lo + end - back, lo + end)
        if best:
            spans = spans or [m.span() for m in WORD.finditer(text or "")]
            found.append({"item_id": block.ids[item], "score": best / (MATCH * len(words)), "start": spans[span[0]][0], "end": spans[span[1] - 1][1]})
    return sorted(found, key=lambda x: (x["item_id"] is None, x["item_id"]))


def _blocks(benchmark: DataFrame, item_text: str, item_id: str, block_bytes: int) -> Iterator[Items]:
    """The benchmark in blocks; how many follows from its bytes, and each is one broadcast."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    n = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        if rows:
            yield Items.of([tuple(r) for r in rows])


def mark(docs: DataFrame, block: Items, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Every row as struct `row` with `leaks`, the items of the block found in it. One pass for counts, one for leaks."""
    context = docs.sparkSession.sparkContext
    items = context.broadcast((block.ids, block.vocabulary, block.words))
    all_keys = [block.keys(w, block.width(i)) for i, w in enumerate(block.words) if len(w)]
    grams = context.broadcast(np.unique(np.concatenate(all_keys)) if all_keys else np.empty(0, np.int64))
    seeds = context.broadcast(seeds_of(block, count_grams(docs, items, grams, text), min_score))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        known = Items(*items.value)
        for batch in batches:
            found = [leaks_in(t, known, seeds.value, min_score) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, kind)], names=["row", "leaks"])

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text] or [F.lit(None).alias("none")]).alias("row"), F.col(text).cast("string").alias("text"))
    return map_batches(packed, work, f"row {packed.schema['row'].dataType.simpleString()}, leaks array<struct<item_id:long,score:double,start:long,end:long>>")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`doc_id`, `item_id`, `score` (share of a full copy's), `start` and `end` (code points) of every leak."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in _blocks(benchmark, item_text, item_id, block_bytes):
        found = mark(source, block, "text", min_score).select(F.col("row.doc_id").alias("doc_id"), F.inline("leaks"))
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, start long, end long")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows without a leak, with the columns of the input."""
    # Text and row travel apart, so that a row keeps all its columns, names and order.
    for block in _blocks(benchmark, item_text, item_id, block_bytes):
        packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), F.col(text).alias("text"))
        docs = mark(packed, block, "text", min_score).where(F.size("leaks") == 0).select("row.whole.*")
    return docs


@query("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a benchmark item in a document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
