"""Triage job: intent, past cases, reply and escalation for a table of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import EscalationLimits, RetrievalSettings
from ..operators import decisions, features, retrieval, similarity
from ..operators.intents import IntentClassifier
from ..session import staged


def triage(
    messages: DataFrame,
    documents: DataFrame,
    dim: int,
    classifier: IntentClassifier | None = None,
    settings: RetrievalSettings = RetrievalSettings(),
    limits: EscalationLimits = EscalationLimits(),
    index: similarity.CellIndex | None = None,
    probe: int = 10,
    skip_same: bool = False,
    pool: DataFrame | None = None,
) -> DataFrame:
    """One row per message: intent, best cases, reply and decision.

    `messages` has id, text, vector and optionally context, draft and retry_draft;
    intent and intent_confidence come from the classifier unless they are columns
    already. `documents` has id, text, reply and vector. Cases are searched exactly,
    or in `probe` cells of an `index` over the same documents, or given as `pool` by a job that
    has searched them before. A message without
    intent, usable vector or past cases is escalated, never dropped.
    """
    if classifier is not None:
        context = "context" if "context" in messages.columns else None
        predicted = classifier.predict(messages, "id", "text", context, settings.context_chars).select(
            "id", "intent", F.col("confidence").alias("intent_confidence")
        )
        messages = messages.drop("intent", "intent_confidence").join(predicted, "id", "left")
    # used by search, drafts and decision: classified once; a micro-batch may be one file, which is one task
    messages = staged(features.spread(messages), "messages")
    if pool is None:
        pool = similarity.top_k(messages, documents, settings.pool, dim, index, probe, skip_same)
    # at most top_k rows per message, used three times below: searched once
    hits = staged(retrieval.rerank(pool, messages, documents, settings), "hits")
    replies = decisions.draft_replies(messages, hits, documents, settings).select(
        "id", "reply", F.col("confidence").alias("reply_confidence"), "summary",
        F.col("escalate").alias("generator_escalates"), F.col("reason").alias("generator_reason"), "n_cases",
    )
    best = retrieval.best_scores(hits).select(F.col("q_id").alias("id"), "best_score")
    ready = messages.select("id", "text", "intent", "intent_confidence").join(replies, "id", "left").join(best, "id", "left")
    return decisions.decide(ready, limits)


def evaluate_golden(triaged: DataFrame, golden: DataFrame) -> DataFrame:
    """Truth next to the triage outcome: (item_id, truth, prediction, should_escalate, escalation_score).

    A golden item without an outcome keeps a null prediction, which counts as wrong.
    """
    return golden.join(triaged, "id", "left").select(
        F.col("id").alias("item_id"), F.col("true_intent").alias("truth"), F.col("intent").alias("prediction"),
        "should_escalate", "escalation_score",
    )
