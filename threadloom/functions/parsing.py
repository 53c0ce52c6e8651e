"""Model answers kept as text: parsing drafts and ratings, building prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import rules
from .text import strip

DRAFT_SCHEMA = (
    "reply string, grounded_claims array<string>, evidence_ids array<int>, "
    "needs_escalation boolean, grounding_confidence double"
)


def unfence(c: Column) -> Column:
    """Content of the first fenced block, or the stripped text without one."""
    t = strip(c)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?(.*?)(?:```|\z)", 1)
    return F.when(t.contains("```"), strip(fenced)).otherwise(t)


def parse_draft(c: Column) -> Column:
    """Struct of reply, confidence, summary, escalation flag and reason.

    Empty and unparsable texts give two different fallbacks, both escalating.
    """
    body = unfence(c)
    # an object is required; arrays, scalars and broken text are unparsable
    readable = F.coalesce(F.try_parse_json(body).isNotNull() & body.startswith("{"), F.lit(False))
    d = F.from_json(body, DRAFT_SCHEMA)
    needs = F.coalesce(d["needs_escalation"], F.lit(False))

    def answer(reply, confidence, summary, escalate, reason):
        return F.struct(
            reply.alias("reply"), confidence.alias("confidence"), summary.alias("summary"),
            escalate.alias("escalate"), reason.cast("string").alias("reason"),
        )

    def fallback(texts):
        reply, summary, reason = (F.lit(t) for t in texts)
        return answer(reply, F.lit(0.0), summary, F.lit(True), reason)

    parsed = answer(
        strip(F.coalesce(d["reply"], F.lit(""))),
        F.coalesce(d["grounding_confidence"], F.lit(0.5)),
        F.concat(F.lit("Claims: "), F.coalesce(F.array_join(d["grounded_claims"], " | "), F.lit(""))),
        needs,
        F.when(needs, F.lit(rules.COMPLEX_REASON)),
    )
    return (
        F.when(F.coalesce(c, F.lit("")) == "", fallback(rules.EMPTY_DRAFT))
        .when(~readable, fallback(rules.UNPARSABLE_DRAFT))
        .otherwise(parsed)
    )


def extract_score(variant: Column, dimension: str) -> Column:
    """Score of one dimension: an object's `score` as is, a number truncated, else null."""
    path = f"$.{dimension}"
    value = F.try_variant_get(variant, path, "variant")
    kind = F.schema_of_variant(value)
    inner = F.try_variant_get(variant, f"{path}.score", "double")
    number = F.try_variant_get(variant, path, "double").try_cast("bigint").cast("double")
    flag = F.try_variant_get(variant, path, "boolean").cast("int").cast("double")
    return (
        F.when(kind.startswith("OBJECT"), inner)
        .when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), number)
        .when(kind == "BOOLEAN", flag)
    )


def parse_judge(c: Column) -> Column:
    """Map dimension -> score, with 3 everywhere when the text is unreadable."""
    body = F.try_parse_json(unfence(c))
    default = F.create_map(*[x for d in rules.DIMENSIONS for x in (F.lit(d), F.lit(3.0))])
    found = F.create_map(*[x for d in rules.DIMENSIONS for x in (F.lit(d), extract_score(body, d))])
    return F.when(body.isNull(), default).otherwise(found)


def judge_overall(c: Column) -> Column:
    """Overall score; null when absent or unreadable."""
    return extract_score(F.try_parse_json(unfence(c)), "overall_score")


def prompt_text(message: Column, intent: Column, confidence: Column, context: Column, evidence: Column) -> Column:
    """Prompt built from a message and its evidence.

    `evidence` is an array of structs (rank, score, customer_message, reply, resolution),
    already in rank order; a null `resolution` is left out.
    """
    def block(e: Column) -> Column:
        fields = F.to_json(
            F.struct(
                e["rank"].alias("evidence_id"),
                F.round(e["score"], 3).alias("similarity"),
                F.coalesce(e["customer_message"], F.lit("N/A")).alias("historical_customer_message"),
                F.coalesce(e["reply"], F.lit("N/A")).alias("historical_support_response"),
                e["resolution"].alias("resolution_type"),
            )
        )
        return F.concat(F.lit("--- Evidence "), e["rank"].cast("string"), F.lit(" ---\n"), fields)

    heading = F.concat(
        F.lit("CURRENT CUSTOMER MESSAGE:\n"), message,
        F.format_string("\n\n[Predicted Intent: %s (Confidence: %.2f)]", intent, confidence),
    )
    ctx = F.when(
        F.coalesce(context, F.lit("")) != "",
        F.concat(
            F.lit("\n\nCURRENT CONVERSATION CONTEXT:\n"), context,
            F.lit("\n(Context helps to understand the message; it is no permission to invent facts)"),
        ),
    ).otherwise(F.lit(""))
    cases = F.when(F.size(evidence) > 0, F.array_join(F.transform(evidence, block), "\n")).otherwise(
        F.lit("None found. (Escalate: there is no evidence)")
    )
    ask = (
        "\n\nINSTRUCTIONS:\nDraft a reply from the HISTORICAL EVIDENCE only. Answer with one JSON object with the "
        "fields reply, grounded_claims, evidence_ids, needs_escalation and grounding_confidence (0.0 to 1.0).\n"
        "Return ONLY valid JSON."
    )
    return F.concat(heading, ctx, F.lit("\n\nHISTORICAL EVIDENCE:\n"), cases, F.lit(ask))
