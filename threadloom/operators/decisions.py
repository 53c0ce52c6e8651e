"""Escalation rules, drafting with an evidence gate, and reuse of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import EscalationLimits, RetrievalSettings
from ..functions import judgement, rules, text as tx
from ..functions.parsing import parse_draft
from . import retrieval

DEFAULT_LIMITS = EscalationLimits()


def escalation(
    message: Column, confidence: Column, best_score: Column, generator: Column | None = None,
    generator_reason: Column | None = None, limits: EscalationLimits = DEFAULT_LIMITS,
) -> Column:
    """Decision struct; the first rule that applies decides, all signals are reported.

    A null confidence counts as 0 and a null best score as no past case, so a
    failed earlier stage always escalates.
    """
    conf = F.coalesce(confidence, F.lit(0.0))
    asked = judgement.asks_for_human(message)
    found = judgement.sensitive_found(message)
    unsure = conf < limits.intent_confidence
    no_case = best_score.isNull()
    weak = no_case | (best_score < limits.retrieval_quality)
    advised = F.coalesce(generator, F.lit(False)) if generator is not None else F.lit(False)
    advice = F.lit(rules.GENERATOR_REASON)
    if generator_reason is not None:
        advice = F.coalesce(F.nullif(generator_reason, F.lit("")), advice)

    weak_reason = F.when(no_case, rules.NO_CASES_REASON).otherwise(
        F.format_string(f"Low retrieval quality (best similarity: %.2f < {limits.retrieval_quality})", best_score)
    )
    unsure_reason = F.format_string(f"Low intent confidence (%.2f < threshold {limits.intent_confidence})", conf)

    def outcome(source: str, reason: Column, escalate: bool = True) -> Column:
        return F.struct(
            F.lit(escalate).alias("should_escalate"),
            F.lit(rules.ESCALATE if escalate else rules.AUTO).alias("decision"),
            F.lit(source).alias("decision_source"),
            reason.cast("string").alias("escalation_reason"),
            F.lit(rules.SCORES[source]).alias("escalation_score"),
            F.lit(limits.echo).alias("escalation_threshold"),
            F.create_map(
                F.lit("explicit_human_request"), asked,
                F.lit("sensitive_content"), F.size(found) > 0,
                F.lit("low_intent_confidence"), unsure,
                F.lit("low_retrieval_quality"), weak,
                F.lit("llm_recommendation"), advised,
            ).alias("signals"),
        )

    return (
        F.when(asked, outcome("explicit_human_request", F.lit(rules.HUMAN_REASON)))
        .when(F.size(found) > 0, outcome("sensitive_content", F.concat(F.lit(rules.SENSITIVE_REASON), F.array_join(found, ", "))))
        .when(unsure, outcome("low_intent_confidence", unsure_reason))
        .when(weak, outcome("insufficient_evidence", weak_reason))
        .when(advised, outcome("llm_recommendation", advice))
        .otherwise(outcome("policy_and_confidence_gate", F.lit(None), escalate=False))
    )


def decide(requests: DataFrame, limits: EscalationLimits = DEFAULT_LIMITS, text_col: str = "text") -> DataFrame:
    """Requests with the decision columns added.

    Reads `intent_confidence`, `best_score` and, when present, `generator_escalates`
    and `generator_reason`. Row-wise: works on streams as well.
    """
    def optional(name):
        return F.col(name) if name in requests.columns else None

    d = escalation(
        F.col(text_col), F.col("intent_confidence"), F.col("best_score"),
        optional("generator_escalates"), optional("generator_reason"), limits,
    )
    return requests.withColumn("__d", d).select(*requests.columns, "__d.*")


def decide_with_hits(messages: DataFrame, hits: DataFrame, limits: EscalationLimits = DEFAULT_LIMITS) -> DataFrame:
    """Escalation only: best score taken from a hit table (q_id, score), no generator signal."""
    best = retrieval.best_scores(hits).withColumnRenamed("q_id", "id")
    return decide(messages.join(best, "id", "left"), limits)


def draft_replies(
    queries: DataFrame, hits: DataFrame, documents: DataFrame, settings: RetrievalSettings = RetrievalSettings()
) -> DataFrame:
    """(id, reply, confidence, summary, escalate, reason, n_cases).

    `queries` may carry `draft` and `retry_draft`, JSON texts of a generator; without
    them the reply of the best past case is the draft. An ungrounded draft is
    replaced by the retry and, failing that too, by a safe text.
    """
    kept = retrieval.evidence(hits, settings.gate_similarity)
    per_query = kept.groupBy("q_id").agg(
        F.count("*").alias("n_cases"), F.min_by(F.struct("d_id", "score"), "rank").alias("best")
    )
    replies = documents.select(F.col("id").alias("d_id"), F.col("reply").alias("best_reply"))
    q = queries.join(per_query.withColumnRenamed("q_id", "id"), "id", "left")
    if "draft" in queries.columns:
        first = parse_draft(F.col("draft"))
        second = parse_draft(F.col("retry_draft")) if "retry_draft" in queries.columns else first
    else:
        q = q.withColumn("d_id", F.col("best.d_id")).join(replies, "d_id", "left").drop("d_id")
        first = second = F.struct(
            F.coalesce("best_reply", F.lit("")).alias("reply"), F.least(F.col("best.score"), F.lit(1.0)).alias("confidence"),
            F.lit("Claims: reply of the most similar past case").alias("summary"), F.lit(False).alias("escalate"),
            F.lit(None).cast("string").alias("reason"),
        )

    def safe(texts) -> Column:
        reply, summary, reason = texts
        return F.struct(
            F.lit(reply).alias("reply"), F.lit(0.0).alias("confidence"), F.lit(summary).alias("summary"),
            F.lit(True).alias("escalate"), F.lit(reason).alias("reason"),
        )

    q = q.withColumn("__1", first).withColumn("__2", second)
    chosen = (
        F.when(F.col("n_cases").isNull(), safe(rules.NO_EVIDENCE))
        .when(judgement.is_grounded(F.col("__1.reply")), F.col("__1"))
        .when(judgement.is_grounded(F.col("__2.reply")), F.col("__2"))
        .otherwise(safe(rules.UNGROUNDED))
    )
    return q.select("id", chosen.alias("c"), F.coalesce("n_cases", F.lit(0)).cast("bigint").alias("n_cases")).select(
        "id", "c.*", "n_cases"
    )


def with_request_key(requests: DataFrame) -> DataFrame:
    return requests.withColumn("request_key", tx.request_key(F.col("text"), F.col("intent"), F.col("n_cases")))


def storable(answers: DataFrame) -> DataFrame:
    """Answers worth keeping for reuse: only those not escalated, one per key."""
    return answers.filter(~F.col("escalate")).groupBy("request_key").agg(
        F.min_by(F.struct("reply", "confidence", "summary"), "id").alias("s")
    ).select("request_key", "s.*")


def reuse_answers(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests with the stored reply, null where there is none yet.

    Keys of a frequent message repeat on the left side only; the store is unique.
    """
    return requests.join(store, "request_key", "left").withColumn("from_store", F.col("reply").isNotNull())


def still_open(requests: DataFrame, store: DataFrame) -> DataFrame:
    return requests.join(store.select("request_key"), "request_key", "left_anti")
