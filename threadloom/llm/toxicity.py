"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its distinct lower-case words, each hashed to one of
2^BITS features. Every feature has a weight and a vector of `FACTORS` numbers;
the product of two vectors is the weight of the pair, so a pair of terms (an
insult and a group) can count for more than both alone.

Learned from at most `TRAIN_ROWS` labelled rows outside the held-out part,
taken in the order of a hash of their id (the bound is that of the training
sample; every row is scored): the weights first, then weights and factors. Nothing but the text enters a score.

Defined results: a null or empty text has no terms and gets the score of the
bias; null labels and null ids are not learned from; an id is learned from once,
with the larger of its labels and one of its texts; documents without label are scored alike; without any training row
all scores are 0.5; repeated rows give repeated result rows; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_batches, stage
from .hashed import Machine, bucket, sigmoid, train
from .registry import query, table

BITS = 18
FACTORS = 8
TRAIN_ROWS = 20_000
#: Words a worker keeps.
WORDS = 300_000
WORD = re.compile(r"\w+")


class Terms(dict):
    """Feature of each word; keeps the first `WORDS` words."""

    def __missing__(self, word: str) -> int:
        found = bucket(word, BITS)
        if len(self) < WORDS and len(word) < 64:
            self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """Distinct features of a text, in order."""
        return np.unique(np.fromiter(map(self.__getitem__, set(WORD.findall(text.lower()))), np.int64))


def sample(docs: DataFrame, labels: DataFrame, text: str, id_col: str, label: str, parts: int, rows: int) -> DataFrame:
    """`features`, `y` of the training rows. Ids are chosen from the labels; only their texts are read."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("double").alias("y")).dropna().where(~held_out("id", parts)).groupBy("id").agg(F.max("y").alias("y"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [terms.of(t or "").tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int32())), batch.column("y")], names=["id", "features", "y"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return map_batches(texts.join(F.broadcast(chosen), "id"), work, "id long, features array<int>, y double").dropDuplicates(["id"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", parts: int = 5, rows: int = TRAIN_ROWS) -> Machine:
    """The machine learned from the sample, which is bounded and so trained in one place."""
    data = stage(sample(docs, labels, text, id_col, label, parts, rows), "toxic-sample").orderBy("id", "y").toArrow()
    features = data.column("features").combine_chunks()
    if not data.num_rows:
        return Machine(0.0, np.zeros(1 << BITS), np.zeros((1 << BITS, 0)))
    lengths = np.array([len(x) for x in features], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ids = features.flatten().to_numpy().astype(np.int64)
    ones, y = np.ones(len(ids)), data.column("y").to_numpy()
    linear = train(starts, ids, ones, y, 1 << BITS, 0, epochs=30, rate=1.0, l1=5e-4, least_rows=5)
    return train(starts, ids, ones, y, 1 << BITS, FACTORS, epochs=10, rate=0.2, l1=2e-4, l2=1e-6, least_rows=5, start=linear)


def score(docs: DataFrame, machine: Machine, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`id` and `score` of every row; no shuffle. The machine's size is fixed by its bits and factors."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, model = Terms(), Machine(*shared.value)
        for batch in batches:
            found = [terms.of(t or "") for t in batch.column("text").to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
            ids = np.concatenate(found) if found else np.empty(0, np.int64)
            p = sigmoid(model.margins(starts, ids.astype(np.int64), np.ones(len(ids))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, work, "id long, score double")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out("id", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
