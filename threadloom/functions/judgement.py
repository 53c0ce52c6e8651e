"""Rule-based judgements on texts: naming, sensitivity, grounding, difficulty."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import rules
from .text import contains_any, strip


def name_cluster(terms: Column, n_terms: int = 10) -> Column:
    """Intent whose keywords occur most often in the joined top terms."""
    joined = F.lower(F.array_join(F.slice(terms, 1, n_terms), " "))
    scored = []
    for order, (name, words) in enumerate(rules.INTENT_KEYWORDS.items()):
        hits = sum((joined.contains(w).cast("int") for w in words), F.lit(0))
        scored.append(F.struct(hits.alias("hits"), F.lit(-order).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, best["name"]).otherwise(F.lit(rules.DEFAULT_INTENT))


def sensitive_found(message: Column) -> Column:
    """Sensitive keywords in the message, in list order."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(w), w) for w in rules.SENSITIVE]))


def asks_for_human(message: Column) -> Column:
    return F.coalesce(strip(F.lower(message)).rlike("|".join(rules.HUMAN_REQUEST)), F.lit(False))


def is_grounded(reply: Column) -> Column:
    """True when the reply claims nothing the system cannot have done."""
    return ~contains_any(F.lower(F.coalesce(reply, F.lit(""))), rules.FORBIDDEN_CLAIMS)


def intent_aligned(intent: Column, message: Column, reply: Column) -> Column:
    msg, rep = (F.lower(F.coalesce(c, F.lit(""))) for c in (message, reply))
    hit = F.lit(False)
    for name, words in rules.INTENT_ALIGNMENT.items():
        hit = hit | ((intent == name) & (contains_any(msg, words) | contains_any(rep, words)))
    return F.coalesce(hit, F.lit(False))


def account_override(
    intent: Column, confidence: Column, context: Column, message: Column, classes: list[str] | None = None
) -> tuple[Column, Column]:
    """Intent and confidence after the account follow-up rule.

    `classes` are the model's classes; without the target class nothing changes.
    """
    if classes is not None and rules.OVERRIDE_INTENT not in classes:
        return intent, confidence
    applies = (
        contains_any(F.lower(F.coalesce(context, F.lit(""))), rules.OVERRIDE_CONTEXT_WORDS)
        & contains_any(F.lower(message), rules.OVERRIDE_MESSAGE_WORDS)
        & ((intent == "other") | (confidence < rules.OVERRIDE_BELOW))
    )
    return (
        F.when(applies, F.lit(rules.OVERRIDE_INTENT)).otherwise(intent),
        F.when(applies, F.greatest(confidence, F.lit(rules.OVERRIDE_CONFIDENCE))).otherwise(confidence),
    )


def difficulty(message: Column) -> Column:
    n, low = F.length(message), F.lower(message)
    return (
        F.when(n < 50, "easy")
        .when(n > 200, "hard")
        .when(message.contains("?") & contains_any(low, rules.QUESTION_WORDS), "medium")
        .when(contains_any(low, rules.HARD_WORDS), "hard")
        .otherwise("medium")
    )


def canned_reply(intent: Column) -> Column:
    return (
        F.when(intent == "account", rules.CANNED_REPLIES["account"])
        .when(intent == "technical", rules.CANNED_REPLIES["technical"])
        .otherwise(rules.CANNED_REPLIES["default"])
    )
