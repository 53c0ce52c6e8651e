"""Quality by weak labels.

`LABELLERS` are cheap rules that vote on a text: good, bad or no vote. They
overlap and err. Expectation-maximisation estimates how each of them votes on
good and on bad texts, and the share of good texts, from the votes of all
documents alone: the votes are counted by pattern (3 to the power of the rules
at most, whatever the number of documents), so the iterations run on that table.

The posterior of a document's pattern is its soft label. A linear scorer over
hashed features (words, their shapes, and how often they repeat) is trained on
the soft labels of `TRAIN_ROWS` documents, taken in the order of a hash of their
id; it generalises the rules to texts on which few of them vote. Every document
is scored whole, and kept if its score is at least `KEEP`.

Labels of the test tables are not read.

Defined results: a null text counts as empty; no rule votes on a text without
words, and it is rejected (score 0); repeated rows count and are scored
repeatedly; ids may be null and serve the sample alone, which takes an id once; other
columns pass through untouched whatever their names; without any document no
scorer is trained and nothing is returned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stage
from .hashed import Machine, bucket, sigmoid, train
from .registry import query, table

TRAIN_ROWS = 20_000
BITS = 16
KEEP = 0.5
ROUNDS = 100
GOOD, BAD, NONE = "g", "b", "-"
WORDS = 300_000


ODD = re.compile(r"[^\w\s.,;:'\"()-]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
MARKS = re.compile(r"[^\w\s]{2,}")
END = re.compile(r"\w[.!?](?=\s|$)")
LETTER = re.compile(r"[^\W\d_]")


def _vote(value: float, good: float, bad: float) -> str:
    """Good up to one bound, bad from the other; the bounds may stand either way round."""
    if bad >= good:
        return GOOD if value <= good else BAD if value >= bad else NONE
    return GOOD if value >= good else BAD if value <= bad else NONE


def _symbols(text: str, words: list[str]) -> str:
    odd = len(ODD.findall(text))
    return _vote(odd / len(words), 0.1, 0.4)


def _shouting(text: str, words: list[str]) -> str:
    return _vote(len(UPPER.findall(text)) / (len(LETTER.findall(text)) or 1), 0.12, 0.3)


def _one_word(text: str, words: list[str]) -> str:
    if len(words) < 20:
        return NONE
    return _vote(max(Counter(words).values()) / len(words), 0.12, 0.2)


def _repeats(text: str, words: list[str]) -> str:
    if len(words) < 10:
        return NONE
    return _vote(sum(a == b for a, b in zip(words, words[1:])) / len(words), 0.02, 0.15)


def _marks(text: str, words: list[str]) -> str:
    return _vote(len(MARKS.findall(text)) / len(words), 0.05, 0.25)


def _bare(text: str, words: list[str]) -> str:
    """Words of one mark alone: table rules, bullets."""
    return _vote(sum(len(w) == 1 and not w.isalnum() for w in words) / len(words), 0.05, 0.2)


def _sentences(text: str, words: list[str]) -> str:
    if len(words) < 10:
        return NONE
    return _vote(len(END.findall(text)) / len(words), 0.03, 0.005)


def _variety(text: str, words: list[str]) -> str:
    if len(words) < 30:
        return NONE
    return _vote(len(set(zip(words, words[1:]))) / len(words), 0.6, 0.35)


#: The rules, each from a text and its words (never empty) to a vote.
LABELLERS = (_symbols, _shouting, _one_word, _repeats, _marks, _bare, _sentences, _variety)


def votes_on(text: str) -> str:
    """The votes of all rules as one string, the pattern."""
    words = text.split()
    return "".join(rule(text, words) for rule in LABELLERS) if words else NONE * len(LABELLERS)


def estimate(patterns: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Probability of being good for each pattern, by expectation-maximisation.

    Votes are independent given the class; whether a rule votes at all depends on
    the text's length and says nothing about the class. The start takes the rules' votes at
    face value, which also fixes which class is called good. A rule's table of
    votes is smoothed by one document of each kind.
    """
    keys = sorted(patterns)
    if not keys:
        return {}
    n = np.array([patterns[k] for k in keys], float)
    seen = np.array([[[v == kind for kind in (GOOD, BAD)] for v in k] for k in keys], float)  # pattern, rule, vote
    good, bad = seen[:, :, 0].sum(axis=1), seen[:, :, 1].sum(axis=1)
    p = (good + 1) / (good + 2 * bad + 2)
    for _ in range(rounds):
        log_odds = np.zeros(len(keys))
        for share, sign in ((p, 1), (1 - p, -1)):
            w = n * share
            table_of = np.einsum("p,prv->rv", w, seen) + 1
            table_of /= table_of.sum(axis=1, keepdims=True)
            log_odds += sign * (np.einsum("prv,rv->p", seen, np.log(table_of)) + np.log(w.sum() + 1))
        new = sigmoid(log_odds)
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return dict(zip(keys, p.tolist()))


class Features(dict):
    """Hashed features of a text: words, their shapes, bare marks, immediate repeats, each by its share of the words."""

    SHAPE = ((re.compile(r"[^\W\d_]*[a-zà-öø-ÿß][^\W\d_]*"), "x"), (re.compile(r"[^\W\d_x]+"), "X"), (re.compile(r"\d+"), "9"))

    def __missing__(self, word: str) -> tuple[int, int]:
        shape = word[:64]
        for pattern, mark in self.SHAPE:
            shape = pattern.sub(mark, shape)
        found = bucket("w " + word.lower(), BITS), bucket("s " + shape, BITS)
        if len(self) < WORDS and len(word) < 64:
            self[word] = found
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts: Counter = Counter()
        for word, n in Counter(words).items():
            a, b = self[word]
            counts[a] += n
            counts[b] += n
        again = sum(a == b for a, b in zip(words, words[1:]))
        if again:
            counts[bucket("again", BITS)] += again
        ids = np.fromiter(counts, np.int64, len(counts))
        return ids, np.sqrt(np.fromiter(counts.values(), float, len(counts)) / max(1, len(words)))


def vote(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns as struct `row`, the text and `votes` of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [votes_on(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.string())], names=["id", "votes"])

    return map_batches(docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("text")), work, "id long, votes string")


def fit(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Machine:
    """The scorer. Votes are taken of all documents; its training sample is bounded by `rows` and so trained in one place."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    voted = stage(vote(source, "text", ["id"]), "votes")
    posterior = estimate(dict(voted.groupBy("votes").count().collect()))
    chosen = voted.dropna().groupBy("id").agg(F.min("votes").alias("votes")).orderBy(F.xxhash64("id"), "id").limit(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.of(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("votes"), pa.array([i.tolist() for i, _ in found], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in found], pa.list_(pa.float64()))],
                names=["id", "votes", "ids", "shares"],
            )

    sample = stage(map_batches(source.join(F.broadcast(chosen), "id"), work, "id long, votes string, ids array<int>, shares array<double>").dropDuplicates(["id"]), "quality-sample").orderBy("id", "votes").toArrow()
    if not sample.num_rows:
        return Machine(0.0, np.zeros(1 << BITS), np.zeros((1 << BITS, 0)))
    ids = sample.column("ids").combine_chunks()
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    target = np.array([posterior[v] for v in sample.column("votes").to_pylist()])
    return train(starts, ids.flatten().to_numpy().astype(np.int64), sample.column("shares").combine_chunks().flatten().to_numpy(), target, 1 << BITS, 0, epochs=15, rate=0.5, l1=1e-4)


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """Every row as struct `row` with its `score`; no shuffle. The scorer's size is fixed by its bits."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, (bias, weights) = Features(), shared.value
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                ids, shares = features.of(t or "")
                out.append(float(sigmoid(bias + weights[ids] @ shares)) if len(ids) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.float64())], names=["row", "score"])

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text"))
    return map_batches(packed, work, f"row {packed.schema['row'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows kept, with the columns of the input."""
    return score(docs, fit(docs, text, id_col), text).where(F.col("score") >= KEEP).select("row.*")


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs))
    return scored.select(F.col("row.doc_id").alias("doc_id"), "score", (F.col("score") >= KEEP).alias("kept"))
