"""Training job: discovery, labels, golden set, classifiers, index and baseline.

Every stage reads what the one before wrote, so a lost executor repeats one
stage at most and no plan grows over the whole job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import BASELINE_TERMS, CLASSIFIER_TERMS, DISCOVERY_TERMS, SEED, TermSettings
from ..operators import golden, intents, metrics, similarity
from ..operators.features import TermModel, fit_terms
from ..session import temporary_stages
from ..sources import tables
from . import golden as golden_job


@dataclass
class Trained:
    taxonomy: DataFrame
    labelled: DataFrame
    golden: DataFrame
    classifier: intents.IntentClassifier
    held_out: DataFrame
    metrics: DataFrame
    index: similarity.CellIndex | None
    baseline: TermModel
    vector_classifier: intents.IntentClassifier | None = None
    vector_metrics: DataFrame | None = None


def run(conversations: DataFrame, out_dir: str, *args, **kwargs) -> Trained:
    """The job of `train`; its stages are deleted at the end, its results are those below `out_dir`."""
    with temporary_stages(conversations.sparkSession):
        return train(conversations, out_dir, *args, **kwargs)


def train(
    conversations: DataFrame, out_dir: str, vectors: DataFrame | None = None, target: int = 200, seed: int = SEED, k: int = 10,
    discovery: TermSettings = DISCOVERY_TERMS, classification: TermSettings = CLASSIFIER_TERMS,
    baseline: TermSettings = BASELINE_TERMS, max_iter: int = 1000, cells: int = 100,
) -> Trained:
    """`conversations` has a numeric or text conversation_id and customer_message."""
    spark = conversations.sparkSession

    def stage(df: DataFrame, name: str) -> DataFrame:
        tables.write_parquet(df, f"{out_dir}/{name}", partition_by=None)
        return spark.read.schema(df.schema).parquet(f"{out_dir}/{name}")

    cleaned = intents.cleaned(conversations, "conversation_id", "customer_message")
    model, found = intents.discover(cleaned, "conversation_id", "customer_message", k, discovery, seed)
    taxonomy = stage(found, "taxonomy")
    model.save(spark, f"{out_dir}/discovery")
    named = model.assign(cleaned, "conversation_id", "customer_message").select("conversation_id", "intent")
    labelled = stage(golden.attach_labels(conversations.drop("intent"), named), "labelled")
    tables.write_report(intents.intent_distribution(labelled), f"{out_dir}/intent_distribution")
    gold = golden_job.run(labelled, out_dir, target, seed)
    rest = golden.exclude_golden(labelled, gold)
    classifier, held = intents.train_text_classifier(rest, "conversation_id", "customer_message", "intent", classification, max_iter)
    classifier.save(spark, f"{out_dir}/classifier")
    held = stage(held, "held_out")
    scores = stage(metrics.classification(held), "metrics")
    index = vector_classifier = vector_scores = None
    if vectors is not None:
        labelled_vectors = rest.select("conversation_id", "intent").join(vectors.withColumnRenamed("id", "conversation_id"), "conversation_id")
        vector_classifier, vector_held = intents.train_vector_classifier(labelled_vectors, "conversation_id", "vector", "intent", max_iter)
        vector_classifier.save(spark, f"{out_dir}/vector_classifier")
        vector_scores = stage(metrics.classification(vector_held), "vector_metrics")
        index = similarity.build_cells(vectors, cells, seed)
        index.save(f"{out_dir}/index")
        index = similarity.CellIndex.load(spark, f"{out_dir}/index")
    base = fit_terms(
        conversations.select(F.col("conversation_id").alias("id"), F.col("customer_message").alias("text")), "id", "text", baseline
    )
    base.save(spark, f"{out_dir}/baseline")
    return Trained(taxonomy, labelled, gold, classifier, held, scores, index, base, vector_classifier, vector_scores)
