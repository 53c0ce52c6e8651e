"""Discovering intents by clustering and predicting them by regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import CLASSIFIER_TERMS, DISCOVERY_TERMS, SEED, RetrievalSettings, TermSettings
from ..functions import judgement, rules, text as tx
from ..functions.ranking import hash_cuts, hash_order, up_to_cut
from ..session import staged
from .features import WORDS, TermModel, fit_terms, spread, words



def _all_classes() -> Window:
    """Window over a whole count table, of one row per class or cluster."""
    return Window.partitionBy()


# --------------------------------------------------------------- clustering


TERM_BLOCK = 256
#: Cells of a dense block of rows, which is what a task holds beside its sum.
BLOCK_CELLS = 1 << 20


def _dense_blocks(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The sparse rows of a batch as dense blocks of at most `BLOCK_CELLS` cells, in order; a block is valid until the next."""
    lengths = pc.fill_null(pc.list_value_length(batch.column("indices")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.r_[0, np.cumsum(lengths)]
    idx = batch.column("indices").flatten().to_numpy(zero_copy_only=False)
    val = batch.column("values").flatten().to_numpy(zero_copy_only=False)
    step = max(1, BLOCK_CELLS // max(size, 1))
    x = np.zeros((min(step, max(len(lengths), 1)), size))
    for lo in range(0, len(lengths), step):
        hi = min(lo + step, len(lengths))
        x[:] = 0.0
        x[np.repeat(np.arange(hi - lo), lengths[lo:hi]), idx[ends[lo] : ends[hi]]] = val[ends[lo] : ends[hi]]
        yield x[: hi - lo]


def _gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """Product of the terms x terms matrix with the columns of `q`, summed on the executors.

    A task adds up its rows, a dense block at a time, and emits the sum in blocks
    of terms; blocks are added per number. The matrix itself is never made.
    """
    sent = rows.sparkSession.sparkContext.broadcast(q)

    def partial(batches):
        v = sent.value
        total = np.zeros_like(v)
        for b in batches:
            for x in _dense_blocks(b, len(v)):
                total += x.T @ (x @ v)
        at = range(0, len(total), TERM_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[i : i + TERM_BLOCK].tobytes() for i in at], pa.binary())], names=["block", "part"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in parts["part"])
        return pd.DataFrame({"block": [parts["block"].iloc[0]], "part": [total.tobytes()]})

    kind = "block int, part binary"
    found = rows.select("indices", "values").mapInArrow(partial, kind).groupBy("block").applyInPandas(add, kind).collect()
    out = np.zeros_like(q)
    for r in found:  # terms x columns in all
        part = np.frombuffer(r["part"]).reshape(-1, q.shape[1])
        out[r["block"] : r["block"] + len(part)] = part
    return out


def fit_projection(rows: DataFrame, size: int, k: int = 100, seed: int = SEED, rounds: int = 7) -> np.ndarray:
    """Right singular vectors (terms x k) of the uncentred term matrix, by randomised subspace iteration.

    `rows` has sparse `indices` and `values` over `size` terms. Every round is one
    pass over the rows; the driver holds terms x (k + 10) numbers.
    """
    k = min(k, size)
    width = min(k + 10, size)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(_gram_times(rows, q))
    _, vectors = np.linalg.eigh(q.T @ _gram_times(rows, q))
    return q @ vectors[:, ::-1][:, :k]


def project(rows: DataFrame, id_col: str, basis: np.ndarray) -> DataFrame:
    """(id, features): sparse rows times the basis, a block of rows at a time."""
    sent = rows.sparkSession.sparkContext.broadcast(basis)

    def apply(batches):
        v = sent.value
        for b in batches:
            at = 0
            for x in _dense_blocks(b, len(v)):
                dense = x @ v
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * v.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(x)), pa.ListArray.from_arrays(ends, pa.array(dense.ravel()))], names=[id_col, "dense"])
                at += len(x)

    key = rows.schema[id_col].dataType.simpleString()
    dense = rows.select(id_col, "indices", "values").mapInArrow(apply, f"{id_col} {key}, dense array<double>")
    return dense.select(id_col, array_to_vector("dense").alias("features"))


def top_cluster_terms(members: DataFrame, weights: DataFrame, id_col: str, n: int = 15) -> DataFrame:
    """(cluster_id, term, mean_weight, rn): best terms by mean weight, absences counting as zero.

    `members` is (id, cluster_id), `weights` (id, term, weight).
    """
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    sums = weights.join(members, id_col).groupBy("cluster_id", "term").agg(F.sum("weight").alias("total"))
    means = sums.join(sizes, "cluster_id").select(
        "cluster_id", "term", F.round(F.col("total") / F.col("size"), 12).alias("mean_weight")
    )
    w = Window.partitionBy("cluster_id").orderBy(F.desc("mean_weight"), "term")
    return means.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def examples(members: DataFrame, texts: DataFrame, id_col: str, text_col: str, n: int = 5) -> DataFrame:
    """First `n` texts of each cluster, by id; only the chosen rows meet their text."""
    w = Window.partitionBy("cluster_id").orderBy(id_col)
    chosen = members.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return chosen.join(texts.select(id_col, text_col), id_col).select("cluster_id", "rn", id_col, text_col)


def cluster_sizes(members: DataFrame) -> DataFrame:
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes.withColumn("pct", F.round(F.col("size") / F.sum("size").over(_all_classes()) * 100, 2))


def taxonomy(members: DataFrame, weights: DataFrame, texts: DataFrame, id_col: str, text_col: str, report: int = 10) -> DataFrame:
    """One row per cluster: name, best terms with weights, size, share and examples, largest first."""
    best = top_cluster_terms(members, weights, id_col).filter(F.col("rn") <= report)
    per_cluster = best.groupBy("cluster_id").agg(
        F.sort_array(F.collect_list(F.struct("rn", "term", "mean_weight"))).alias("t")
    ).select("cluster_id", F.col("t.term").alias("terms"), F.col("t.mean_weight").alias("weights"))
    shown = examples(members, texts, id_col, text_col).groupBy("cluster_id").agg(
        F.sort_array(F.collect_list(F.struct("rn", text_col))).alias("e")
    ).select("cluster_id", F.col(f"e.{text_col}").alias("examples"))
    return (
        cluster_sizes(members).join(per_cluster, "cluster_id", "left").join(shown, "cluster_id", "left")
        .withColumn("name", judgement.name_cluster(F.coalesce("terms", F.array().cast("array<string>"))))
        .orderBy(F.desc("size"), "cluster_id")
    )


def intent_distribution(labelled: DataFrame, column: str = "intent") -> DataFrame:
    """Messages and share per intent; clusters of one name are counted together."""
    counts = labelled.groupBy(F.col(column).alias("intent")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") / F.sum("n").over(_all_classes()) * 100, 2))


def name_members(members: DataFrame, names: DataFrame) -> DataFrame:
    """Intent name of every member; clusters without a name get the default."""
    small = F.broadcast(names.select("cluster_id", F.col("name").alias("intent")))  # one row per cluster
    return members.join(small, "cluster_id", "left").withColumn(
        "intent", F.coalesce("intent", F.lit(rules.DEFAULT_INTENT))
    )


@dataclass
class IntentModel:
    """Fitted discovery: vocabulary, projection, clusters and their names."""

    terms: TermModel
    basis: np.ndarray
    clusters: KMeansModel
    names: dict[int, str]

    def _placed(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, features, prediction) of every row."""
        if WORDS not in df.columns:
            texts = spread(df.select(id_col, text_col))
            df = texts.select(id_col, tx.clean_for_clustering(F.coalesce(F.col(text_col), F.lit(""))).alias(text_col))
        rows = self.terms.transform(df, id_col, text_col)
        return self.clusters.transform(project(rows, id_col, self.basis))

    def cluster(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, cluster_id) of every row, whatever its length."""
        return self._placed(df, id_col, text_col).select(id_col, F.col("prediction").alias("cluster_id"))

    def placement(self, df: DataFrame, id_col: str, text_col: str, slack: float = 1e-9) -> DataFrame:
        """(n, clusters, not_nearest): rows placed, clusters in use, and rows that another centre is nearer to, by distances computed here."""
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self.clusters.clusterCenters()])
        rows = self._placed(df, id_col, text_col).select(vector_to_array("features").alias("v"), "prediction")
        square = lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)
        far = rows.select("prediction", F.transform(centres, square).alias("far"))
        return far.agg(
            F.count("*").alias("n"), F.count_distinct("prediction").alias("clusters"),
            F.count_if(F.get("far", F.col("prediction")) > F.array_min("far") + slack).alias("not_nearest"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.terms.save(spark, f"{path}/terms")
        self.clusters.write().overwrite().save(f"{path}/clusters")
        basis = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(self.basis)], "index int, row array<double>")
        basis.write.mode("overwrite").parquet(f"{path}/basis")  # one row per term
        spark.createDataFrame(list(self.names.items()), "cluster_id int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IntentModel":
        basis = np.array([r["row"] for r in spark.read.parquet(f"{path}/basis").orderBy("index").collect()])
        names = {r["cluster_id"]: r["name"] for r in spark.read.parquet(f"{path}/names").collect()}
        return cls(TermModel.load(spark, f"{path}/terms"), basis, KMeansModel.load(f"{path}/clusters"), names)

    def assign(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        names = df.sparkSession.createDataFrame(list(self.names.items()), "cluster_id int, name string")
        return name_members(self.cluster(df, id_col, text_col), names)


def cleaned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, present, word array) of every row, cleaned for clustering; staged, for a job that both discovers and assigns."""
    texts = spread(df.select(id_col, text_col))
    clean = staged(texts.select(id_col, tx.clean_for_clustering(F.coalesce(F.col(text_col), F.lit(""))).alias(text_col), F.col(text_col).isNotNull().alias("__present")), "clean")
    return staged(clean.withColumn(WORDS, words(F.col(text_col))), "words")


def discover(
    df: DataFrame, id_col: str, text_col: str, k: int = 10, settings: TermSettings = DISCOVERY_TERMS,
    seed: int = SEED, components: int = 100,
) -> tuple[IntentModel, DataFrame]:
    """Fitted model and the taxonomy of its clusters, of texts or of what `cleaned` made of them."""
    every = df if WORDS in df.columns else cleaned(df, id_col, text_col)
    clean = every.filter(F.col("__present") & (F.length(text_col) > 10))
    terms = fit_terms(clean, id_col, text_col, settings)
    rows = terms.stage_rows(clean, id_col, text_col)
    basis = fit_projection(rows.sparse(), terms.size, components, seed)
    dense = staged(project(rows.sparse(), id_col, basis), "projected")
    model = KMeans(k=k, seed=seed, featuresCol="features").fit(dense)
    members = model.transform(dense).select(id_col, F.col("prediction").alias("cluster_id"))
    found = staged(taxonomy(members, term_weights(rows.sparse(), terms, id_col), clean, id_col, text_col), "taxonomy")
    found = found.orderBy(F.desc("size"), "cluster_id")
    names = {r["cluster_id"]: r["name"] for r in found.select("cluster_id", "name").collect()}  # k rows
    return IntentModel(terms, basis, model, names), found


def term_weights(rows: DataFrame, terms: TermModel, id_col: str) -> DataFrame:
    """(id, term, weight) from sparse rows."""
    vocab = terms.as_frame(rows.sparkSession).select("index", "term")  # at most max_features rows
    pairs = rows.select(id_col, F.explode(F.arrays_zip("indices", "values")).alias("p"))
    return pairs.select(id_col, F.col("p.indices").alias("index"), F.col("p.values").alias("weight")).join(
        F.broadcast(vocab), "index"
    ).select(id_col, "term", "weight")


# ----------------------------------------------------------- classification


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds `is_test`: the first share of every label in hash order, so shares are exact.

    The last test row of a label is its cut, found by counting leading digits of
    hashes; rows are marked by comparing with the cuts, one per label, and texts
    and vectors stay where they are.
    """
    order = hash_order(F.col(id_col), seed)
    keys = df.select(F.col(label_col).alias("label"), order.alias("h"), F.col(id_col).alias("id"))
    quotas = keys.groupBy("label").agg(F.round(F.count("*") * test_share).cast("bigint").alias("quota")).filter("quota > 0")
    cuts = hash_cuts(keys, quotas, "label", "h", "id").withColumnRenamed("label", label_col)
    return up_to_cut(df, cuts, label_col, order, F.col(id_col)).withColumnRenamed("first", "is_test")


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """(label, weight) with weight n / (classes * n_c); one row per class."""
    counts = df.groupBy(label_col).agg(F.count("*").alias("n_c"))
    return counts.select(
        label_col, (F.sum("n_c").over(_all_classes()) / (F.count("*").over(_all_classes()) * F.col("n_c"))).alias("weight")
    )


def encode_labels(df: DataFrame, label_col: str) -> DataFrame:
    """(label, code): labels numbered in alphabetical order."""
    labels = df.select(F.col(label_col).alias("label")).filter(F.col("label").isNotNull()).distinct()  # one row per class
    return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint").alias("code"))


@dataclass
class IntentClassifier:
    """Regression over TF-IDF rows (with `terms`) or over given vectors (without)."""

    model: LogisticRegressionModel
    classes: list[str]
    terms: TermModel | None = None

    def predict_features(self, features: DataFrame, keep: list[str]) -> DataFrame:
        return self._decided(self.model.transform(features).select(*keep, vector_to_array("probability").alias("__p")), keep)

    def _decided(self, scored: DataFrame, keep: list[str]) -> DataFrame:
        """Best class from the probabilities in `__p`."""
        p = F.col("__p")
        named = F.array(*[
            F.struct(p[i].alias("p"), F.lit(-i).alias("order"), F.lit(c).alias("c")) for i, c in enumerate(self.classes)
        ])
        best = best_class(named)
        return scored.select(
            *keep, best["c"].alias("intent"), best["p"].alias("confidence"),
            F.map_from_arrays(F.array(*[F.lit(c) for c in self.classes]), p).alias("probabilities"),
        )

    def predict_sparse(self, rows: DataFrame, id_col: str) -> DataFrame:
        """Predictions for TF-IDF rows (id, indices, values), lazily and in built-in expressions.

        The coefficients are a table of one row per term, bounded by the vocabulary
        and broadcast; a row's cells are summed per class where the row was made.
        """
        spark = rows.sparkSession
        matrix, start = self.model.coefficientMatrix.toArray(), self.model.interceptVector.toArray()
        table = spark.createDataFrame([(i, [float(x) for x in column]) for i, column in enumerate(matrix.T)], "index int, w array<double>")
        cells = rows.select(id_col, F.explode_outer(F.arrays_zip("indices", "values")).alias("c")).select(
            id_col, F.col("c.indices").alias("index"), F.col("c.values").alias("value")
        )
        classes = range(len(self.classes))
        summed = cells.join(F.broadcast(table), "index", "left").groupBy(id_col).agg(
            *[F.coalesce(F.sum(F.col("value") * F.col("w")[i]), F.lit(0.0)).alias(f"m{i}") for i in classes]
        )
        margins = summed.select(id_col, *[(F.col(f"m{i}") + float(start[i])).alias(f"m{i}") for i in classes])
        top = F.array_max(F.array(*[F.col(f"m{i}") for i in classes]))
        powers = margins.withColumn("__top", top).select(id_col, F.array(*[F.exp(F.col(f"m{i}") - F.col("__top")) for i in classes]).alias("__e"))
        whole = powers.withColumn("__s", F.aggregate("__e", F.lit(0.0), lambda a, x: a + x))
        return self._decided(whole.select(id_col, F.transform("__e", lambda x: x / F.col("__s")).alias("__p")), [id_col])

    def predict(self, df: DataFrame, id_col: str, text_col: str, context_col: str | None = None, context_chars: int = RetrievalSettings.context_chars) -> DataFrame:
        """(id, intent, confidence, probabilities), with the last characters of the context and the account rule when given."""
        if context_col is None:
            inputs = df.select(id_col, F.col(text_col).alias("__in"))
        else:
            inputs = df.select(id_col, tx.with_context(F.col(context_col), F.col(text_col), context_chars).alias("__in"))
        out = self.predict_sparse(self.terms.transform(inputs, id_col, "__in"), id_col)
        if context_col is None:
            return out
        joined = out.join(df.select(id_col, text_col, context_col), id_col)
        intent, confidence = judgement.account_override(
            F.col("intent"), F.col("confidence"), F.col(context_col), F.col(text_col), self.classes
        )
        return joined.select(id_col, intent.alias("intent"), confidence.alias("confidence"), "probabilities")

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/regression")
        rows = [(i, c) for i, c in enumerate(self.classes)]
        spark.createDataFrame(rows, "code int, label string").coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")
        if self.terms is not None:
            self.terms.save(spark, f"{path}/terms")

    @classmethod
    def load(cls, spark: SparkSession, path: str, with_terms: bool = True) -> "IntentClassifier":
        labels = [r["label"] for r in spark.read.parquet(f"{path}/classes").orderBy("code").collect()]
        terms = TermModel.load(spark, f"{path}/terms") if with_terms else None
        return cls(LogisticRegressionModel.load(f"{path}/regression"), labels, terms)


def best_class(scored: Column) -> Column:
    """Highest of an array of structs (p, order, c)."""
    return F.array_max(scored)


def fit_regression(train: DataFrame, label_col: str, max_iter: int = 1000) -> tuple[LogisticRegressionModel, list[str]]:
    """Multinomial regression with balanced classes and unit inverse penalty.

    Balanced weights sum to n, so the mean loss needs a penalty of 1/n.
    """
    indexer = StringIndexer(inputCol=label_col, outputCol="code", stringOrderType="alphabetAsc").fit(train)
    weighted = indexer.transform(train).join(F.broadcast(class_weights(train, label_col)), label_col).cache()
    try:
        n = weighted.count()
        model = LogisticRegression(
            family="multinomial", featuresCol="features", labelCol="code", weightCol="weight",
            regParam=1.0 / max(n, 1), standardization=False, maxIter=max_iter, tol=1e-4,
        ).fit(weighted)
    finally:
        weighted.unpersist()
    return model, list(indexer.labels)


def _halves(df: DataFrame, id_col: str, value_col: str, label_col: str, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows, staged; of texts the word arrays, cut once for all that follows."""
    rows = df.select(F.col(id_col).alias("item_id"), F.col(value_col).alias("value"), F.col(label_col).alias("truth"))
    split = staged(stratified_split(rows, "item_id", "truth"), "split")
    if texts:
        split = staged(spread(split).select("item_id", words(F.col("value")).alias(WORDS), "truth", "is_test"), "words")
    return split.filter(~F.col("is_test")), split.filter("is_test")


def _judged(predicted: DataFrame) -> DataFrame:
    return predicted.select("item_id", "truth", F.col("intent").alias("prediction"), "confidence")


def train_text_classifier(
    df: DataFrame, id_col: str, text_col: str, label_col: str, settings: TermSettings = CLASSIFIER_TERMS, max_iter: int = 1000
) -> tuple[IntentClassifier, DataFrame]:
    """Classifier and its predictions (item_id, truth, prediction, confidence) on the held-out part."""
    train, test = _halves(df, id_col, text_col, label_col, texts=True)
    terms = fit_terms(train, "item_id", "value", settings)
    model, classes = fit_regression(terms.transform_to_vectors(train, "item_id", "value", keep=["truth"]), "truth", max_iter)
    classifier = IntentClassifier(model, classes, terms)
    held = terms.transform_to_vectors(test, "item_id", "value", keep=["truth"])
    return classifier, _judged(classifier.predict_features(held, ["item_id", "truth"]))


def train_vector_classifier(
    df: DataFrame, id_col: str, vector_col: str, label_col: str, max_iter: int = 1000
) -> tuple[IntentClassifier, DataFrame]:
    """As above, on vectors that came with the rows."""
    def featured(part: DataFrame) -> DataFrame:
        return part.select("item_id", "truth", array_to_vector(F.col("value").cast("array<double>")).alias("features"))

    train, test = _halves(df, id_col, vector_col, label_col)
    model, classes = fit_regression(featured(train).select("truth", "features"), "truth", max_iter)
    classifier = IntentClassifier(model, classes)
    return classifier, _judged(classifier.predict_features(featured(test), ["item_id", "truth"]))
