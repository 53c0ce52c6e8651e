"""Two simple ways to answer, to compare the full job with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import BASELINE_TERMS, TermSettings
from ..functions import judgement, rules
from .features import TermModel, cut, fit_terms
from .similarity import sparse_top_k_held

LOW = 0.1  # below this similarity the nearest reply is not trusted


def canned(messages: DataFrame, id_col: str = "id", intent_col: str | None = None) -> DataFrame:
    """The same reply for everybody, by intent key at most."""
    intent = F.col(intent_col) if intent_col else F.lit(None).cast("string")
    return messages.select(
        id_col, judgement.canned_reply(intent).alias("reply"), F.lit(rules.CANNED_CONFIDENCE).alias("confidence"),
        F.lit(False).alias("should_escalate"),
    )


def similar_history(
    asks: DataFrame, history: DataFrame, k: int = 1, settings: TermSettings = BASELINE_TERMS, model: TermModel | None = None, skip_same: bool = False
) -> DataFrame:
    """Sparse similarity join: k most similar past messages with any shared term, by TF-IDF cosine.

    `asks` and `history` have id and text. History is cut into words once, for the
    vocabulary and for its rows, and searched through posting lists of parts of it. `skip_same` leaves
    out a past message with the ask's own id.
    """
    past = cut(history, "id", "text", model.stop_words if model else None)
    model = model or fit_terms(past, "id", "text", settings)
    return sparse_top_k_held(model.transform(asks, "id", "text"), model.transform(past, "id", "text"), k, model.size, skip_same=skip_same)


def nearest_reply(
    asks: DataFrame, history: DataFrame, settings: TermSettings = BASELINE_TERMS, model: TermModel | None = None, skip_same: bool = False
) -> DataFrame:
    """Reply of the most similar past message, verbatim; nothing shared gives an empty reply."""
    best = similar_history(asks, history, 1, settings, model, skip_same)
    joined = asks.select("id").join(best.withColumnRenamed("q_id", "id"), "id", "left").join(
        history.select(F.col("id").alias("d_id"), F.col("text").alias("similar_message"), "reply"), "d_id", "left"
    )
    score = F.coalesce("score", F.lit(0.0))
    return joined.select(
        "id", F.col("d_id").alias("similar_id"), F.coalesce("reply", F.lit("")).alias("reply"), score.alias("confidence"),
        (score < LOW).alias("should_escalate"),
        F.when(score < LOW, "Low similarity match").alias("escalation_reason"),
        "similar_message",
    )
