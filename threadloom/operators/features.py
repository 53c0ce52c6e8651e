"""TF-IDF as DataFrame arithmetic.

Texts stay where they are: the vocabulary comes from counts combined by term,
and a document's terms leave it as vocabulary numbers. The vocabulary is the
model: at most `max_features` rows, so it may be held by the driver and
broadcast. Texts are cut into words by Spark's expressions; words and pairs are
counted as numbers in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..config import TermSettings
from ..functions import rules
from ..session import scratch_path, staged


def words(c: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-cased words of two characters and more, without stop words."""
    stop = rules.ENGLISH_STOP_WORDS if stop_words is None else stop_words
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({rules.TOKEN})"), 1)
    return F.filter(found, lambda w: ~w.isin(stop)) if stop else found


def terms(w: Column) -> Column:
    """The words and the pairs of neighbouring words, of a word array without stop words.

    Takes a column and not the expression behind it, which would be evaluated
    again at each of its uses.
    """
    pairs = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(w, F.filter(pairs, lambda p: p.isNotNull()))


#: Column of the word array of rows that `cut` has gone over.
WORDS = "__words"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows dealt out evenly if a split holds more than twice its share of them.

    The number of splits says little: a Parquet file is cut by bytes, and all rows of
    a row group go to the split that has its middle. So rows are counted per split,
    which reads footers only. Whole rows move, none by a hash of its text; a table
    whose splits are even, or one that a shuffle made, stays as it is.
    """
    wanted = partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n")).collect()]  # one row per split
    if not sizes or max(sizes) * wanted <= 2 * sum(sizes):
        return df
    return df.repartition(max(wanted, df.rdd.getNumPartitions()))


def cut(df: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """(id, word array), staged: for a job that both fits and transforms, so that texts are cut into words once."""
    rows = spread(df.select(id_col, text_col), partitions)
    return staged(rows.select(id_col, words(F.col(text_col), stop_words).alias(WORDS)), "words")


def _cut_rows(df: DataFrame, text_col: str, stop_words: list[str] | None, *keep: str) -> DataFrame:
    """Rows with their word array: as they are if they were cut before, spread over the cores if not."""
    if WORDS in df.columns:
        return df.select(*keep, WORDS)
    return spread(df.select(*keep, text_col)).select(*keep, words(F.col(text_col), stop_words).alias(WORDS))


def term_frequencies(df: DataFrame, text_col: str, stop_words: list[str] | None = None) -> DataFrame:
    """(term, df, cf): rows holding the term, and its occurrences; of texts, or of rows that `cut` made.

    A row's terms are sorted, so the first of each run counts for `df`; both
    numbers are combined by term before the shuffle, and no text is hashed.
    """
    runs = F.transform("__terms", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get(F.col("__terms"), i - 1) != x)).alias("first")))
    return (
        _cut_rows(df, text_col, stop_words)
        .select(F.sort_array(terms(F.col("__words"))).alias("__terms"))
        .select(F.inline(runs))
        .groupBy("term").agg(F.count_if("first").alias("df"), F.count("*").alias("cf"))
    )


#: Words of a block that is counted at once.
BLOCK_WORDS = 1 << 20
#: Counters that pairs of words share, and how many of them are one block of a task's sum.
BUCKETS, BUCKET_BLOCK = 1 << 20, 1 << 16


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """Parts of a batch of word arrays: first and last row, distinct words, and of each word its number among these and its row in the part."""
    column = batch.column(WORDS)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - lengths[lo] + BLOCK_WORDS, "right")))
        found = column.slice(lo, hi - lo).flatten().dictionary_encode()
        yield lo, hi, found.dictionary, found.indices.to_numpy().astype(np.int64), np.repeat(np.arange(hi - lo), lengths[lo:hi])
        lo = hi


def _neighbours(row: np.ndarray) -> np.ndarray:
    """Places of words that are followed by one of the same row."""
    return np.flatnonzero(row[1:] == row[:-1])


def _buckets(names: pa.Array, code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The counter of each pair of neighbours that begins `at`."""
    hashes = np.fromiter((crc32(w) for w in names.cast(pa.binary()).to_pylist()), np.uint64, len(names))
    mixed = (hashes[code[at]] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[code[at + 1]] * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % BUCKETS


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, cf) of words by block of rows, and the task's counters of pairs as (block, part)."""
    names = ["term", "df", "cf", "block", "part"]
    counters = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, found, code, row in _blocks(batch):
            n = len(found)
            cf = np.bincount(code, minlength=n)
            df = np.bincount(np.unique(row * n + code) % max(n, 1), minlength=n)
            yield pa.RecordBatch.from_arrays([found, pa.array(df), pa.array(cf), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            counters += np.bincount(_buckets(found, code, _neighbours(row)), minlength=BUCKETS)
    at = [i for i in range(0, BUCKETS, BUCKET_BLOCK) if counters[i : i + BUCKET_BLOCK].any()]
    none = [pa.nulls(len(at), kind) for kind in (pa.string(), pa.int64(), pa.int64())]
    yield pa.RecordBatch.from_arrays([*none, pa.array(at, pa.int32()), pa.array([counters[i : i + BUCKET_BLOCK].tobytes() for i in at], pa.binary())], names=names)


def _add_counters(parts: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in parts["part"])
    return pd.DataFrame({"block": [parts["block"].iloc[0]], "part": [total.tobytes()]})


def kept_frequencies(rows: DataFrame, n_docs: int, settings: TermSettings) -> DataFrame:
    """(term, df, cf) as by `term_frequencies`, without terms that cannot be among the `max_features`.

    `rows` are staged word arrays, which are read twice. `max_features` words that may be kept set the
    least `cf` that a term needs. Pairs of words share counters at first, which are never less than a pair's
    own count: only pairs whose counter reaches that `cf` are counted by name.
    """
    spark = rows.sparkSession
    counted = staged(rows.select(WORDS).mapInArrow(_count_words, "term string, df bigint, cf bigint, block int, part binary"), "counted")
    single = staged(counted.filter(F.col("block").isNull()).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), "single-words")
    n, least = vocabulary(single, n_docs, settings).agg(F.count("*"), F.min("cf")).first()
    least = max(1, settings.min_df, least if n >= settings.max_features and n else 0)
    reached = np.zeros(BUCKETS, bool)
    for r in counted.filter(F.col("block").isNotNull()).groupBy("block").applyInPandas(_add_counters, "block int, part binary").toLocalIterator():  # BUCKETS numbers in all
        reached[r["block"] : r["block"] + BUCKET_BLOCK] = np.frombuffer(r["part"], np.int64) >= least
    shared = spark.sparkContext.broadcast(reached)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, found, code, row in _blocks(batch):
                at = _neighbours(row)
                at = at[shared.value[_buckets(found, code, at)]]
                pair = code[at] * len(found) + code[at + 1]
                order = np.argsort(pair, kind="stable")  # rows stay in order
                pair, of = pair[order], row[at][order]
                new = np.r_[True, pair[1:] != pair[:-1]][: len(pair)]
                first = np.flatnonzero(new)
                df = np.add.reduceat((new | np.r_[True, of[1:] != of[:-1]][: len(of)]).astype(np.int64), first) if len(first) else first
                one, two = (found.take(pa.array(x)) for x in np.divmod(pair[first], max(len(found), 1)))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(one, two, " "), pa.array(df), pa.array(np.diff(np.append(first, len(pair))))], names=["term", "df", "cf"])

    pairs = rows.select(WORDS).mapInArrow(count_pairs, "term string, df bigint, cf bigint")
    return single.unionByName(pairs.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))


def vocabulary(frequencies: DataFrame, n_docs: int, settings: TermSettings) -> DataFrame:
    """(term, df, cf) of the terms kept: by document share, then by corpus frequency."""
    return (
        frequencies.filter((F.col("df") >= settings.min_df) & (F.col("df") <= settings.max_df * n_docs))
        .orderBy(F.desc("cf"), "term").limit(settings.max_features)
    )


@dataclass
class StagedRows:
    """Sparse rows on disk, readable as arrays or as ML vectors.

    The vector type is stored as a struct of (type, size, indices, values), so a
    struct column read back under the vector type is a vector, without a Python
    function. The files also cut the lineage for iterative training.
    """

    spark: SparkSession
    path: str
    fields: list[T.StructField]

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.fields, T.StructField("features", VectorUDT())])).parquet(self.path)

    def sparse(self) -> DataFrame:
        cells = T.StructType([T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])
        raw = self.spark.read.schema(T.StructType([*self.fields, T.StructField("features", cells)])).parquet(self.path)
        return raw.select(*[f.name for f in self.fields], "features.indices", "features.values")


@dataclass
class TermModel:
    """Fitted vocabulary with document frequencies; `table` is in term order."""

    table: pd.DataFrame  # term, df, cf
    n_docs: int
    settings: TermSettings
    stop_words: list[str] | None = None

    @property
    def size(self) -> int:
        return len(self.table)

    def as_frame(self, spark: SparkSession) -> DataFrame:
        """(term, df, cf, index, idf)."""
        rows = self.table.assign(index=range(len(self.table)))
        df = spark.createDataFrame(rows, "term string, df bigint, cf bigint, index int")
        return df.withColumn("idf", F.log((1 + self.n_docs) / (1 + F.col("df"))) + 1)

    def transform(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, indices, values): unit-length sparse rows, empty for documents without known terms.

        `df` has texts, or is what `cut` made of them. Terms become vocabulary numbers where the text is; what is shuffled by id
        are numbers. Rows of one id are one document.
        """
        size, key = self.size, df.schema[id_col].dataType.simpleString()
        terms_of = self.table["term"].tolist()
        single = {t: i for i, t in enumerate(terms_of) if " " not in t}
        pairs = [(*t.split(" "), i) for i, t in enumerate(terms_of) if " " in t]
        part = {w: i for i, w in enumerate(dict.fromkeys(w for p in pairs for w in p[:2]))}
        pair_keys = np.array([part[a] * len(part) + part[b] for a, b, _ in pairs], np.int64)
        order = np.argsort(pair_keys)
        idf = np.log((1 + self.n_docs) / (1 + self.table["df"].to_numpy(np.float64))) + 1
        sublinear = self.settings.sublinear
        # at most max_features rows
        shared = df.sparkSession.sparkContext.broadcast((single, part, pair_keys[order], np.array([i for _, _, i in pairs], np.int64)[order], idf))
        lists = lambda x, ends, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            single, part, pair_keys, pair_index, _ = shared.value
            for batch in batches:
                for lo, hi, found, code, row in _blocks(batch):
                    names = found.to_pylist()
                    index = np.fromiter((single.get(w, -1) for w in names), np.int64, len(names))[code]
                    known = index >= 0
                    cells = [row[known] * size + index[known]]
                    if len(pair_keys):
                        word = np.fromiter((part.get(w, -1) for w in names), np.int64, len(names))[code]
                        at = _neighbours(row)
                        at = at[(word[at] >= 0) & (word[at + 1] >= 0)]
                        wanted = word[at] * len(part) + word[at + 1]
                        place = np.minimum(np.searchsorted(pair_keys, wanted), len(pair_keys) - 1)
                        hit = pair_keys[place] == wanted
                        cells.append(row[at[hit]] * size + pair_index[place[hit]])
                    cell, tf = np.unique(np.concatenate(cells), return_counts=True)
                    ends = np.searchsorted(cell, np.arange(hi - lo + 1) * size)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo), lists(cell % max(size, 1), ends, pa.int32()), lists(tf, ends, pa.int32())], names=[id_col, "indices", "tf"])

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf = shared.value[4]

            def weighed(batch: pa.RecordBatch) -> pa.RecordBatch:
                first = np.flatnonzero(batch.column("n").to_numpy() == 1)
                of = np.repeat(np.arange(len(first)), np.diff(np.append(first, batch.num_rows)))
                lengths = pc.list_value_length(batch.column("indices")).to_numpy(zero_copy_only=False)
                cell = np.repeat(of, lengths) * size + batch.column("indices").flatten().to_numpy()
                tf = batch.column("tf").flatten().to_numpy().astype(np.float64)
                if len(first) < batch.num_rows:
                    cell, to = np.unique(cell, return_inverse=True)
                    tf = np.bincount(to, tf, len(cell)).astype(np.float64)
                index, of = cell % max(size, 1), cell // max(size, 1)
                weight = (1 + np.log(tf) if sublinear else tf) * idf[index]
                squares = np.bincount(of, weight * weight, len(first)).astype(np.float64)
                ends = np.searchsorted(of, np.arange(len(first) + 1))
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first)), lists(index, ends, pa.int32()), lists(weight / np.sqrt(squares[of]), ends, pa.float64())], names=[id_col, "indices", "values"])

            held = None  # the last id, whose rows may go on in the next batch
            for batch in batches:
                if not batch.num_rows:
                    continue
                batch = batch if held is None else pa.concat_batches([held, batch])
                last = int(np.flatnonzero(batch.column("n").to_numpy() == 1)[-1])
                if last:
                    yield weighed(batch.slice(0, last))
                held = batch.slice(last)
            if held is not None:
                yield weighed(held)

        counts = _cut_rows(df, text_col, self.stop_words, id_col).mapInArrow(look_up, f"`{id_col}` {key}, indices array<int>, tf array<int>")
        runs = counts.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy(id_col)))
        return runs.mapInArrow(weigh, f"`{id_col}` {key}, indices array<int>, values array<double>")

    def stage_rows(self, df: DataFrame, id_col: str, text_col: str, keep: list[str] = ()) -> "StagedRows":
        """Rows of `transform` written to the scratch folder, with `keep` columns of `df`."""
        rows = self.transform(df, id_col, text_col)
        if keep:
            rows = rows.join(df.select(id_col, *keep), id_col)
        path = scratch_path(df.sparkSession, "features")
        rows.select(
            id_col, *keep,
            F.struct(
                F.lit(0).cast("tinyint").alias("type"), F.lit(self.size).cast("int").alias("size"), "indices", "values"
            ).alias("features"),
        ).write.parquet(path)
        return StagedRows(df.sparkSession, path, [df.schema[c] for c in (id_col, *keep)])

    def transform_to_vectors(self, df: DataFrame, id_col: str, text_col: str, keep: list[str] = ()) -> DataFrame:
        """As `transform`, with an ML vector column `features`, through the scratch folder."""
        return self.stage_rows(df, id_col, text_col, keep).vectors()

    def save(self, spark: SparkSession, path: str) -> None:
        meta = F.struct(F.lit(self.n_docs).cast("bigint").alias("n_docs"), F.lit(self.settings.min_df).alias("min_df"),
                        F.lit(self.settings.max_df).alias("max_df"), F.lit(self.settings.max_features).alias("max_features"),
                        F.lit(self.settings.sublinear).alias("sublinear"),
                        (F.lit(None) if self.stop_words is None else F.array(*[F.lit(w) for w in self.stop_words])).cast("array<string>").alias("stop_words"))
        self.as_frame(spark).withColumn("meta", meta).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TermModel":
        rows = spark.read.parquet(path).orderBy("index").toPandas()
        m = rows["meta"].iloc[0]
        settings = TermSettings(m["min_df"], m["max_df"], m["max_features"], m["sublinear"])
        return cls(rows[["term", "df", "cf"]], int(m["n_docs"]), settings, None if m["stop_words"] is None else list(m["stop_words"]))


def fit_terms(
    df: DataFrame, id_col: str, text_col: str, settings: TermSettings, stop_words: list[str] | None = None
) -> TermModel:
    n_docs = df.count()
    rows = df if WORDS in df.columns else staged(_cut_rows(df, text_col, stop_words), "words")
    table = vocabulary(kept_frequencies(rows, n_docs, settings), n_docs, settings).toPandas()  # <= max_features rows
    return TermModel(table.sort_values("term").reset_index(drop=True), n_docs, settings, stop_words)
