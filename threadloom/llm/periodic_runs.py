"""Periodic runs in texts, by seeds on diagonals.

A run is a longest stretch of words with smallest period q in which words q apart
are equal, of at least `MIN_LENGTH` words and `MIN_PERIODS` periods. On the diagonal of lag
q it is a row of equal pairs of words, at least (MIN_PERIODS - 1) * q of them and
at least MIN_LENGTH - q. So all runs of periods from c to (MIN_PERIODS - 1) * c hold equal
k-grams q apart for k = (MIN_PERIODS - 1) * c, the overlap they guarantee; a few
lengths k, each three times the one before, serve all periods.

For each k the places of equal k-grams are found, and pairs of places that follow
each other are seeds. Since k is no less than the period, a k-gram of a run returns
after one period and no sooner, so the next place is always the one on the run's
diagonal, and seeds are no more than words. A seed is extended to both sides along
its diagonal as far as words are equal. A table holds for each lag the place up to
which its diagonal is covered; seeds before that place are skipped.

k-grams are compared exactly: they are numbered by doubling, a number for each
distinct pair of numbers of their halves. A k-gram that occurs once in the text is
never part of a longer one that repeats, so places drop out, and a text without
repeats is done after the first length.

Defined results: words are separated by ASCII white space; a null text counts as
empty and has no runs; repeated rows give repeated result rows; ids may be null;
other columns are not read; an empty table gives an empty result. A document is
one row and one task's work, in time that grows with n log n; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, texts
from .registry import query, table

MIN_LENGTH, MIN_PERIODS = 6, 4


def seed_lengths(words: int, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[int]:
    """Lengths k of seeds: runs whose periods are above the last k, up to this one, hold equal k-grams a period apart."""
    out, period = [], 1
    while max(min_length, min_periods * period) <= words:
        # For the least period of the class and for all above it.
        k = min(max((min_periods - 1) * q, min_length - q) for q in range(period, max(period + 1, min_length + 1)))
        out.append(k)
        period = k + 1
    return out


def _numbers(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A number for each pair that occurs more than once, -1 for all others and where a part is -1."""
    out = np.full(len(one), -1, np.int64)
    at = np.nonzero((one >= 0) & (two >= 0))[0]
    if len(at):
        _, which, count = np.unique(one[at] * (int(two.max()) + 1) + two[at], return_inverse=True, return_counts=True)
        out[at] = np.where(count[which] > 1, which, -1)
    return out


class Grams:
    """Numbers of a text's k-grams, asked for in ascending order of k: equal numbers are equal k-grams, -1 occurs once."""

    def __init__(self, words: np.ndarray) -> None:
        self.length, self.numbers = 1, words

    def _spread(self, by: int) -> np.ndarray:
        """The numbers of grams that are longer by `by`, at most by the length of those at hand."""
        return _numbers(self.numbers[: len(self.numbers) - by], self.numbers[by:])

    def of(self, k: int) -> np.ndarray:
        while 2 * self.length <= k:
            self.length, self.numbers = 2 * self.length, self._spread(self.length)
        return self._spread(k - self.length) if k > self.length else self.numbers


def _equal_until(words: np.ndarray, at: int, lag: int) -> int:
    """First place from `at` where the word `lag` further on is another, or is not there."""
    end, step = len(words) - lag, 64
    while at < end:
        to = min(end, at + step)
        other = np.nonzero(words[at:to] != words[at + lag : to + lag])[0]
        if len(other):
            return at + int(other[0])
        at, step = to, 2 * step
    return end


def runs_of(words: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """`start`, `length`, `period` of all runs of a text given as word numbers, by start, then period."""
    grams, backwards = Grams(words), words[::-1]
    found: dict[tuple[int, int], int] = {}
    last = 0
    for k in seed_lengths(len(words), min_length, min_periods):
        numbers = grams.of(k)
        places = np.nonzero(numbers >= 0)[0]
        if not len(places):
            break  # no k-gram repeats, so no longer one does
        order = places[np.argsort(numbers[places], kind="stable")]
        lags = np.diff(order)
        seeds = np.nonzero((numbers[order[1:]] == numbers[order[:-1]]) & (lags > last) & (lags <= k))[0]
        at, lags = order[seeds], lags[seeds]
        by_lag = np.lexsort((at, lags))
        at, lags = at[by_lag], lags[by_lag]
        covered: dict[int, int] = {}
        i = 0
        while i < len(at):
            place, lag = int(at[i]), int(lags[i])
            if place >= covered.get(lag, 0):
                end = _equal_until(words, place, lag)
                # Backwards, the text is read from its end: the pair (place, place + lag) is met in the other order.
                start = len(words) - lag - _equal_until(backwards, len(words) - lag - place, lag)
                covered[lag] = end
                length = end - start + lag
                if length >= max(min_length, min_periods * lag):
                    # The same stretch at a multiple of its period is not another run; lags come in ascending order.
                    found.setdefault((start, length), lag)
            stop = i + int(np.searchsorted(lags[i:], lag, side="right"))
            i += max(1, int(np.searchsorted(at[i:stop], covered[lag])))
        last = k
    return sorted((start, length, period) for (start, length), period in found.items())


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: of each run only its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def find_runs(df: DataFrame, text: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """`id`, `n_words`, `runs` (start, length, period; by start, then period) and `collapsed`, the text with one period of each run, one blank between words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            sizes, runs, left = [], [], []
            for value in texts(batch.column("text")):
                words = value.split()
                seen: dict[bytes, int] = {}
                numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
                found = runs_of(numbers, min_length, min_periods)
                if found:
                    words = [words[i] for i in np.nonzero(collapse(len(words), found))[0].tolist()]
                sizes.append(len(numbers))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                left.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(left, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, work, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones the first, then that of the smallest period. Null without runs."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.when(F.size(runs) > 0, F.array_min(order))


def _repeated(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by crc32 of its id, repeats some of its own words to the end, as the query's contract sets down."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g")).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit("[^ \\t-\\r]+"), F.lit(0))))
    sized = words.withColumn("n", F.coalesce(F.size("words"), F.lit(0)).cast("long"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    # Word i from a on is word a + (i - a) % p.
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


#: crc32 bit by bit, of the id's digits; runs as islands of equal five-word pairs on a diagonal.
_SQL = r"""
with base as (select doc_id, coalesce(text, '') t, coalesce(doc_id::varchar, '') s from documents),
bits as (select doc_id, t, list_prepend(4294967295::bigint, flatten(list_transform(string_split(s, ''), lambda c: list_transform(range(8), lambda k: ((ascii(c) >> k::int) & 1)::bigint)))) l from base),
hashed as (select doc_id, t, xor(list_reduce(l, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) h from bits),
cut as (select doc_id, h, h // 10 g, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') ws from hashed),
sized as (select *, len(ws) n, case when len(ws) > 0 then g % len(ws) end a from cut),
placed as (select *, 1 + (n - a) // (3 + g % 8) p from sized),
words as (select doc_id, i, case when h % 10 = 0 and i >= a then ws[1 + a + (i - a) % p] else ws[1 + i] end w from (select *, unnest(range(n)) i from placed)),
grams as (select doc_id, i, w || chr(10) || lead(w, 1) over v || chr(10) || lead(w, 2) over v || chr(10) || lead(w, 3) over v || chr(10) || lead(w, 4) over v k from words window v as (partition by doc_id order by i)),
pairs as (select x.doc_id, x.i, y.i - x.i q from grams x join grams y on x.doc_id = y.doc_id and x.k = y.k and x.i < y.i),
islands as (select doc_id, q, min(i) s, count(*) + 4 + q len from (select *, i - row_number() over (partition by doc_id, q order by i) island from pairs) group by doc_id, q, island),
runs as (select doc_id, s, len, min(q) q from islands where len >= greatest(6, 4 * q) group by doc_id, s, len),
best as (select doc_id, count(*) n_runs, arg_min(struct_pack(s := s, len := len, q := q), (-len, s, q)) r, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) runs from runs group by doc_id),
gone as (select distinct w.doc_id, w.i from words w join runs r on w.doc_id = r.doc_id and w.i >= r.s + r.q and w.i < r.s + r.len),
kept as (select w.doc_id, string_agg(w.w, ' ' order by w.i) c from words w left join gone g on w.doc_id = g.doc_id and w.i = g.i where g.i is null group by w.doc_id)
select d.doc_id, coalesce(n_runs, 0) n_runs, r.s "start", r.len "length", r.q period, (1000 * r.len) // r.q exponent_milli, sha256(coalesce(runs, '')) runs_sha256, sha256(coalesce(c, '')) collapsed_sha256
from base d left join best b on d.doc_id = b.doc_id left join kept k on d.doc_id = k.doc_id
"""


@query("op11_periodic_runs", _SQL)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, its longest run, and digests of all runs and of the collapsed text."""
    found = find_runs(_repeated(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = F.col("best")
    return found.withColumn("best", longest(F.col("runs"))).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
