"""Phrase collocations, counted in HAT-tries that spill sorted runs.

A task counts the phrases of its documents in a trie over word numbers, which takes
the distinct phrases of a stretch of text at a time. A trie is shallow: below a language and a first word hangs one hash container of the rest of
the phrases, and only a container that grows beyond `BURST` entries bursts into a
node with a container for each next word. When the trie holds `ENTRIES` phrases, its
largest subtrees leave it whole, each as a run sorted by its words, until half is
left. Runs are shuffled by language and first word, so all runs of a prefix meet in one
partition and are merged there; the second words below a first word are dealt to a few
partitions. A word number has 21 bits, so phrases have three words at most.

Phrases are counted by length, and a phrase can only occur as often as asked for if
both phrases that it is made of by leaving out its first or its last word do. So each
length is counted with a filter made of the counts before it: a table of bits at the
hashes of the frequent shorter phrases. A bit set by another phrase lets a phrase
through that is counted for nothing; none is lost. The filter is broadcast, and its
size is a parameter and no more than a few bits for each frequent phrase.

Counts are exact, and scores are computed in whole numbers of 38 digits.

Defined results: letters A-Z are lower-cased; pieces end at `.,;:!?` and line ends,
words at blanks and tabs; a null text counts as empty, a null language is `und`;
repeated rows count again; equal scores are told apart by count, then by the bytes
of the phrase; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stage, map_batches, stage, texts
from .registry import query, table

MIN_COUNT = 10
MAX_WORDS = 3
#: A candidate goes if a longer one that holds it occurs this share of times, in percent.
CONTAINED_PERCENT = 50
TOP = 2000
#: Phrases a container holds before it bursts, and a task's trie before it spills.
BURST = 4096
ENTRIES = 1_000_000
#: Partitions that the second words below one first word are dealt to.
SECOND_WORDS = 16
#: Words a task holds numbers of before it begins anew.
WORDS_HELD = 600_000
#: Bytes of text a task counts at once, rows it hands over at once, and bits of a word number.
CHUNK = 1 << 20
OUT_ROWS = 50_000
WORD_BITS = 21
#: Bits of the filter for each frequent phrase, and bits at most (32 MB).
BITS_EACH, BITS_AT_MOST = 32, 1 << 28
#: Bytes of the filter that one task puts together.
BLOCK = 1 << 16
_SEPARATORS = bytes.maketrans(b".,;:!?\n\v\f\r", b"..........")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; `.` stands between pieces, no word is or holds one."""
    return text.lower().translate(_SEPARATORS).replace(b".", b" . ").split()


class Trie:
    """Counts of phrases of one length.

    Phrases come as one number each, `WORD_BITS` bits for each of their word numbers, the first word uppermost.
    """

    def __init__(self, length: int, burst: int = BURST) -> None:
        self.length, self.burst = length, burst
        self.shift = WORD_BITS * (length - 1)
        #: By first word: how many phrases are below, the container (rest of the phrase: count) or the node (next word: container), and which of both.
        self.root: dict[int, list] = {}
        self.size = 0

    def add(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        """Count distinct phrases, given in ascending order."""
        firsts = phrases >> self.shift
        cuts = np.flatnonzero(np.diff(firsts, prepend=-1))
        rests, numbers = (phrases & ((1 << self.shift) - 1)).tolist(), counts.tolist()
        for first, start, end in zip(firsts[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(rests)]):
            below = self.root.get(first)
            if below is None:
                below = self.root[first] = [0, {}, False]
            before = below[0]
            if below[2]:
                for rest, n in zip(rests[start:end], numbers[start:end]):
                    at = below[1].setdefault(rest >> self.shift - WORD_BITS, {})
                    below[0] += rest not in at
                    at[rest] = at.get(rest, 0) + n
            elif before:
                at = below[1]
                for rest, n in zip(rests[start:end], numbers[start:end]):
                    at[rest] = at.get(rest, 0) + n
                below[0] = len(at)
            else:
                below[1] = dict(zip(rests[start:end], numbers[start:end]))
                below[0] = end - start
            self.size += below[0] - before
            if below[0] > self.burst and not below[2] and self.length > 2:
                node: dict[int, dict] = {}
                for rest, n in below[1].items():
                    node.setdefault(rest >> self.shift - WORD_BITS, {})[rest] = n
                below[1], below[2] = node, True

    def spill(self, left: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases and counts of whole subtrees, the largest first, until `left` phrases stay."""
        for first in sorted(self.root, key=lambda w: -self.root[w][0]):
            if self.size <= left:
                return
            size, at, deep = self.root.pop(first)
            self.size -= size
            for part in at.values() if deep else [at]:
                yield np.fromiter(part, np.int64, len(part)) + (first << self.shift), np.fromiter(part.values(), np.int64, len(part))


class Words(Trie):
    """The trie of phrases of one word: its root is its only container."""

    def __init__(self) -> None:
        super().__init__(1)

    def add(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        root = self.root
        for word, n in zip(phrases.tolist(), counts.tolist()):
            root[word] = root.get(word, 0) + n
        self.size = len(root)

    def spill(self, left: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size > left:
            yield np.fromiter(self.root, np.int64, self.size), np.fromiter(self.root.values(), np.int64, self.size)
            self.root, self.size = {}, 0


class Filter:
    """Hashes of the phrases that may be part of longer ones; says yes to all that were put in."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    @classmethod
    def of_size(cls, phrases: int, bits_each: int = BITS_EACH, at_most: int = BITS_AT_MOST) -> Filter:
        return cls(np.zeros(min(at_most, 1 << max(10, (bits_each * phrases - 1).bit_length())) // 8, np.uint8))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = hashes & self.mask
        return (at >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        byte, bit = self.places(hashes)
        return self.bits[byte] & bit != 0


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for the hashes of a phrase's words; the language is not in it."""
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = (out + part) * _FACTOR
        out ^= out >> np.uint64(29)
    return out


def _schema(length: int) -> str:
    return "lang string, " + ", ".join(f"w{i} string" for i in range(1, length + 1)) + ", f long"


def count_phrases(rows: DataFrame, length: int, known: Filter | None = None, burst: int = BURST, entries: int = ENTRIES) -> DataFrame:
    """`lang`, `w1`… and `f` of all phrases whose parts are in the filter; `rows` has `lang` and `text`."""
    if length > 63 // WORD_BITS:
        raise ValueError(f"phrases of {63 // WORD_BITS} words at most")
    shared = rows.sparkSession.sparkContext.broadcast(known.bits) if known is not None else None
    columns = [f"w{i}" for i in range(1, length + 1)]

    class Numbers(dict):
        """Numbers of the words met; `.` is 0."""

        def __init__(self) -> None:
            super().__init__({b".": 0})
            self.names, self.known = [b"."], np.zeros(1, np.uint64)

        def __missing__(self, word: bytes) -> int:
            at = self[word] = len(self.names)
            self.names.append(word)
            return at

        def hashes(self) -> np.ndarray:
            """Hashes of all words so far; only new words are hashed."""
            new = self.names[len(self.known) :]
            self.known = np.concatenate([self.known, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
            return self.known

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lets = Filter(shared.value) if shared is not None else None
        tries: dict[str, Trie] = {}
        ids = Numbers()

        def run(left_of) -> Iterator[pa.RecordBatch]:
            """What leaves the tries, as one run sorted by language and words."""
            taken = [(lang, *part) for lang in sorted(tries) for part in tries[lang].spill(left_of(tries[lang]))]
            if not taken:
                return
            phrases, counts = np.concatenate([t[1] for t in taken]), np.concatenate([t[2] for t in taken])
            langs = {lang: k for k, lang in enumerate(sorted(tries))}
            of = np.repeat([langs[t[0]] for t in taken], [len(t[1]) for t in taken])
            words = [phrases >> WORD_BITS * (length - 1 - i) & (1 << WORD_BITS) - 1 for i in range(length)]
            names = pa.array(ids.names, pa.binary())
            place = np.empty(len(names), np.int64)
            place[pa.compute.sort_indices(names).to_numpy()] = np.arange(len(names))
            order = np.lexsort([place[w] for w in words[::-1]] + [of])
            names = names.cast(pa.string())
            for at in range(0, len(order), OUT_ROWS):
                some = order[at : at + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(sorted(tries), pa.string()).take(pa.array(of[some])), *[names.take(pa.array(w[some])) for w in words], pa.array(counts[some])], names=["lang", *columns, "f"])

        def count(lang: str, some: list[bytes]) -> None:
            words = words_of(b".".join(some))
            seen = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
            n = len(seen) - length + 1
            if n <= 0:
                return
            inside, phrases = np.ones(n, bool), np.zeros(n, np.int64)
            for i in range(length):
                inside &= seen[i : i + n] > 0
                phrases = phrases << WORD_BITS | seen[i : i + n]
            if lets is not None:
                own = ids.hashes()[seen]
                parts = lets.has(_mixed([own[i : i + n + 1] for i in range(length - 1)]))
                inside &= parts[:n] & parts[1 : n + 1]
            if lang not in tries:
                tries[lang] = Trie(length, burst) if length > 1 else Words()
            tries[lang].add(*np.unique(phrases[inside], return_counts=True))

        waiting: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text"))):
                own = waiting.setdefault(lang, [0, []])
                own[0] += len(text) + 1
                own[1].append(text)
                if own[0] >= CHUNK:
                    del waiting[lang]
                    count(lang, own[1])
                    if sum(t.size for t in tries.values()) >= entries:
                        yield from run(lambda t: t.size // 2)
                    if len(ids.names) > WORDS_HELD:
                        # New word numbers: all runs of the old ones leave first.
                        yield from run(lambda t: -1)
                        ids = Numbers()
            if sum(own[0] for own in waiting.values()) >= 8 * CHUNK:
                # Many languages with little text each.
                for lang, own in waiting.items():
                    count(lang, own[1])
                waiting = {}
        for lang, own in waiting.items():
            count(lang, own[1])
            if len(ids.names) > WORDS_HELD:
                yield from run(lambda t: -1)
                ids = Numbers()
        yield from run(lambda t: -1)

    spilled = map_batches(rows.select("lang", "text"), work, _schema(length))
    # A prefix partition is a first word, of which second words are dealt to some partitions, so that a frequent word is not one task's.
    # Rows of a run that go the same way still stand together with their first word, which keeps the shuffle small.
    part = F.pmod(F.xxhash64(columns[1]), F.lit(SECOND_WORDS)) if length > 1 else F.lit(0).cast("long")
    parts = spilled.withColumn("part", part).repartition("lang", "w1", "part")
    return parts.groupBy("lang", "w1", "part", *columns[1:]).agg(F.sum("f").alias("f")).drop("part")


def filter_of(counted: DataFrame, length: int, bits_each: int = BITS_EACH, at_most: int = BITS_AT_MOST) -> Filter:
    """The filter of all phrases of a table, put together in blocks; no more than its own size reaches the driver."""
    made = Filter.of_size(counted.count(), bits_each, at_most)
    size, mask = min(len(made.bits), BLOCK), made.mask
    words = [f"w{i}" for i in range(1, length + 1)]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = mask & _mixed([np.array([xxhash.xxh64_intdigest(w) for w in texts(batch.column(c))], np.uint64) for c in words])
            blocks, within = np.divmod(at.astype(np.int64), 8 * size)
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(within)], names=["block", "place"])

    def fill(rows: pa.Table) -> pa.Table:
        bits = np.zeros(8 * size, bool)
        bits[rows.column("place").to_numpy()] = True
        return pa.table({"block": [rows.column("block")[0].as_py()], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    found = map_batches(counted.select(*words), places, "block long, place long").groupBy("block").applyInArrow(fill, "block long, bits binary")
    for row in found.collect():
        made.bits[row.block * size : (row.block + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return made


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, burst: int = BURST, entries: int = ENTRIES) -> tuple[list[DataFrame], DataFrame]:
    """Staged tables of all phrases of 1, 2, … words that occur `min_count` times or more, and `lang`, `n`, all words counted.

    Texts are read once for each length.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    counted, known, total = [], None, None
    for length in range(1, max_words + 1):
        found = stage(count_phrases(rows, length, known, burst, entries).where((F.col("f") >= min_count) | F.lit(length == 1)), f"phrases-{length}")
        if length == 1:
            total = stage(found.groupBy("lang").agg(F.sum("f").alias("n")), "words")
            often = stage(found.where(F.col("f") >= min_count), "phrases-1")
            drop_stage(found)
            found = often
        counted.append(found)
        if length < max_words:
            known = filter_of(found, length)
    return counted, total


def _count_of(counted: list[DataFrame], first: int, words: int, name: str) -> tuple[DataFrame, list[str]]:
    """Counts of the part of `words` words that begins with word `first`, named for a join."""
    keys = [f"w{first + i}" for i in range(words)]
    return counted[words - 1].select("lang", *[F.col(f"w{i + 1}").alias(k) for i, k in enumerate(keys)], F.col("f").alias(name)), ["lang", *keys]


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly; at most 1000000."""
    wide = lambda c: c.cast("decimal(19,0)")
    product = wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)")
    parts = wide(left) * wide(right)
    # Decimal quotients are rounded, so the remainder is taken off first.
    return ((product - product % parts) / parts).cast("long")


def candidates(counted: list[DataFrame]) -> DataFrame:
    """`lang`, `words`, `phrase`, `a`, `l`, `r`, `score` of the lowest-scoring cut (of equal ones the first) of all phrases of two words and more."""
    out = None
    for length in range(2, len(counted) + 1):
        found = counted[length - 1].withColumnRenamed("f", "a")
        cuts = []
        for k in range(1, length):
            left, keys = _count_of(counted, 1, k, f"l{k}")
            right, also = _count_of(counted, 1 + k, length - k, f"r{k}")
            found = found.join(left, keys).join(right, also)
            cuts.append(F.struct(score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        words = F.array(*[F.col(f"w{i}") for i in range(1, length + 1)])
        best = F.array_min(F.array(*cuts))
        part = found.select("lang", words.alias("words"), F.array_join(words, " ").alias("phrase"), "a", best.alias("best")).select("lang", "words", "phrase", "a", "best.l", "best.r", "best.score")
        out = part if out is None else out.union(part)
    return out


def not_contained(counted: list[DataFrame], found: DataFrame, percent: int = CONTAINED_PERCENT) -> DataFrame:
    """The candidates that no longer candidate of at least `percent` of their count holds."""
    held = None
    for longer in range(3, len(counted) + 1):
        for size in range(2, longer):
            for first in range(1, longer - size + 2):
                part = counted[longer - 1].select("lang", F.array(*[F.col(f"w{first + i}") for i in range(size)]).alias("words"), F.col("f").alias("longer"))
                held = part if held is None else held.union(part)
    if held is None:
        return found
    most = held.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    # Counts are below 2^53, so their hundredfold fits.
    return found.join(most, ["lang", "words"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, burst: int = BURST, entries: int = ENTRIES) -> DataFrame:
    """Each language's best phrases: `lang`, `rank`, `phrase`, `words`, `a`, `l`, `r`, `n`, `score`."""
    counted, total = frequent_phrases(docs, text, lang, min_count, max_words, burst, entries)
    left = not_contained(counted, candidates(counted))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # A rank with an upper bound is cut in each task before the shuffle.
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "words", "a", "l", "r", "n", "score")


_SQL = r"""
with pieces as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents),
cut as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') ws from pieces),
places as (select lang, ws, unnest(range(1, len(ws) + 1)) i from cut),
words as materialized (select lang, ws[i] x, ws[i + 1] y, ws[i + 2] z from places),
total as (select lang, count(*) n from words group by lang),
one as materialized (select lang, x, count(*) f from words group by lang, x having count(*) >= 10),
two as materialized (select lang, x, y, count(*) f from words where y is not null group by lang, x, y having count(*) >= 10),
three as materialized (select lang, x, y, z, count(*) f from words where z is not null group by lang, x, y, z having count(*) >= 10),
cuts as (
  select t.lang, t.x || ' ' || t.y phrase, 2 k, t.f a, 1 j, a.f l, b.f r from two t join one a on a.lang = t.lang and a.x = t.x join one b on b.lang = t.lang and b.x = t.y
  union all select t.lang, t.x || ' ' || t.y || ' ' || t.z, 3, t.f, 1, a.f, b.f from three t join one a on a.lang = t.lang and a.x = t.x join two b on b.lang = t.lang and b.x = t.y and b.y = t.z
  union all select t.lang, t.x || ' ' || t.y || ' ' || t.z, 3, t.f, 2, a.f, b.f from three t join two a on a.lang = t.lang and a.x = t.x and a.y = t.y join one b on b.lang = t.lang and b.x = t.z),
scored as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint score from cuts),
best as (select *, row_number() over (partition by lang, phrase order by score, j) nth from scored),
gone as (select lang, phrase, max(f) longer from (select lang, x || ' ' || y phrase, f from three union all select lang, y || ' ' || z, f from three) group by lang, phrase),
kept as (select b.lang, b.phrase, b.a, b.l, b.r, b.score from best b left join gone g on g.lang = b.lang and g.phrase = b.phrase and b.k = 2 where nth = 1 and (g.longer is null or 100 * g.longer < 50 * b.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000
"""


@query("op13_collocations", _SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two and three words."""
    return collocations(table(spark, sf_dir, "documents")).drop("words")
