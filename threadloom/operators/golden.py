"""Building and annotating the golden evaluation set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import SEED
from ..functions import judgement, rules
from ..functions.ranking import hash_cuts, hash_order, number_rows, sample_rows, up_to_cut


def allocate(counts: DataFrame, target: int) -> DataFrame:
    """(intent, c, n): examples per intent from its count `c`; one row per intent throughout.

    Proportional with a floor, at most the stratum; what is left goes to the
    largest intents, five at a time.
    """
    everything = Window.partitionBy()
    floor_n = F.greatest(F.lit(5), F.floor(F.lit(target) / (F.col("k") * 3)))
    share = F.floor(F.lit(target) * F.col("c") / F.col("total"))
    base = (
        counts.select("intent", "c", F.count("*").over(everything).alias("k"), F.sum("c").over(everything).alias("total"))
        .withColumn("base", F.least(F.greatest(floor_n, share), F.col("c")))
        .withColumn("left", F.lit(target) - F.sum("base").over(everything))
        .withColumn("place", F.row_number().over(Window.orderBy(F.desc("c"), "intent")))
    )
    extra = F.greatest(F.lit(0), F.least(F.lit(5), F.col("left") - 5 * (F.col("place") - 1)))
    return base.select("intent", "c", (F.col("base") + extra).cast("bigint").alias("n"))


def sample_strata(df: DataFrame, target: int = 200, seed: int = SEED) -> DataFrame:
    """(conversation_id, intent, pool) chosen per intent: typical, unusual and further examples.

    Only ids, lengths and hashes travel. An allocation never exceeds `target + 5`,
    so the first `target + 5` rows of each (intent, pool) hold every row that can
    be chosen, and what follows runs on that small remainder.
    """
    rows = df.select("conversation_id", "intent", F.length("customer_message").alias("len"), hash_order(F.col("conversation_id"), seed).alias("h"))
    stats = rows.groupBy("intent").agg(F.count("*").alias("c"), F.median("len").alias("mid"))
    plan = allocate(stats.select("intent", "c"), target).join(stats.select("intent", "mid"), "intent")
    pooled = rows.join(plan, "intent").withColumn(
        "common", (F.col("len") > F.col("mid") * 0.5) & (F.col("len") < F.col("mid") * 1.5)
    )
    order = [F.col("h"), F.col("conversation_id")]
    pooled = pooled.withColumn("both", F.struct("intent", "common"))
    quotas = pooled.groupBy("both").agg(F.least(F.count("*"), F.lit(target + 5)).alias("quota"))
    cuts = hash_cuts(pooled, quotas, "both", "h", "conversation_id")
    few = up_to_cut(pooled, cuts, "both", F.col("h"), F.col("conversation_id")).filter("first")
    head = few.withColumn("rn", F.row_number().over(Window.partitionBy("intent", "common").orderBy(*order)))
    n = F.col("n")
    n_common, n_rare = F.floor(n * 0.6), F.floor(n * 0.2)
    whole = F.col("c") <= n
    marked = head.withColumn(
        "pool",
        F.when(whole, "whole").when(F.col("common") & (F.col("rn") <= n_common), "common")
        .when(~F.col("common") & (F.col("rn") <= n_rare), "rare"),
    )
    rest = Window.partitionBy("intent", F.col("pool").isNull()).orderBy(*order)
    further = marked.withColumn("rest", F.row_number().over(rest))
    return (
        further.withColumn(
            "pool", F.when(F.col("pool").isNull() & (F.col("rest") <= n - n_common - n_rare), "further").otherwise(F.col("pool"))
        )
        .filter(F.col("pool").isNotNull())
        .select("conversation_id", "intent", "pool")
    )


def shuffle_and_trim(chosen: DataFrame, target: int, seed: int = SEED) -> DataFrame:
    """At most `target` rows, in hash order."""
    return sample_rows(chosen, "conversation_id", target, seed + 1)


def golden_records(df: DataFrame, stratified: bool) -> DataFrame:
    """Golden examples with empty human fields next to the machine's suggestion."""
    def optional(name):
        return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")

    intent = optional("intent") if stratified else F.lit("")
    blank = {c: F.lit("") for c in ("expected_escalation", "expected_reasoning", "human_verified_intent", "human_verified_escalation", "human_notes")}
    return df.select(
        "conversation_id", "customer_message", intent.alias("true_intent"),
        optional("historical_support_response").alias("historical_response"),
        optional("conversation_context").alias("conversation_context"),
        judgement.difficulty(F.col("customer_message")).alias("difficulty"),
        F.lit("stratified" if stratified else "random").alias("sampling_category"),
        intent.alias("machine_suggested_intent"),
        F.lit(rules.MACHINE_NOTE if stratified else rules.NO_MACHINE_NOTE).alias("machine_suggestion_note"),
        *[v.alias(c) for c, v in blank.items()],
        F.lit(False).alias("is_human_verified"),
    )


def build_golden_set(df: DataFrame, target: int = 200, seed: int = SEED) -> DataFrame:
    """Stratified over intents when there are several, random otherwise."""
    several = "intent" in df.columns and df.select("intent").filter(F.col("intent").isNotNull()).distinct().limit(2).count() > 1
    if several:
        chosen = shuffle_and_trim(sample_strata(df, target, seed), target, seed).select("conversation_id")
        return golden_records(df.join(chosen, "conversation_id"), True)
    return golden_records(sample_rows(df, "conversation_id", target, seed), False)


def distributions(golden: DataFrame) -> DataFrame:
    """(kind, value, n): intents, difficulties and verified examples."""
    cells = [F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"))
             for k, c in (("intent", "true_intent"), ("difficulty", "difficulty"), ("verified", "is_human_verified"))]
    return golden.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def exclude_golden(conversations: DataFrame, golden: DataFrame) -> DataFrame:
    """Training conversations: those not in the golden set."""
    return conversations.join(golden.select("conversation_id"), "conversation_id", "left_anti")


def attach_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, "conversation_id", "left")


def review_table(golden: DataFrame) -> DataFrame:
    """Second golden layout: machine fields kept, human fields empty."""
    keep = ["conversation_id", "customer_message", "true_intent", "conversation_context", "historical_response",
            "difficulty", "sampling_category", "machine_suggested_intent"]
    return golden.select(
        *[c for c in keep if c in golden.columns],
        F.lit(False).alias("machine_suggested_escalation"), F.lit(rules.REVIEW_PENDING).alias("machine_reason"),
        F.lit(None).cast("string").alias("human_intent"), F.lit(None).cast("boolean").alias("human_escalation"),
        F.lit(None).cast("string").alias("human_reason"), F.lit(False).alias("human_reviewed"),
        F.lit(None).cast("string").alias("reviewer_notes"),
    )


def unknown_updates(golden: DataFrame, updates: DataFrame) -> DataFrame:
    return updates.select("conversation_id").distinct().join(golden.select("conversation_id"), "conversation_id", "left_anti")


def apply_updates(golden: DataFrame, updates: DataFrame, order_col: str, strict: bool = True) -> DataFrame:
    """Golden rows with human fields set by the last update of each id.

    The last update wins by `order_col`. With `strict` an id that is not in the
    golden set raises.
    """
    fields = ["human_intent", "human_escalation", "human_reason", "reviewer_notes"]
    if strict and not unknown_updates(golden, updates).isEmpty():
        raise KeyError("an update names a conversation that is not in the golden set")
    last = updates.groupBy("conversation_id").agg(F.max_by(F.struct(*fields), F.col(order_col)).alias("__u"))
    out = golden.join(last, "conversation_id", "left")
    given = F.col("__u").isNotNull()
    for f in fields:
        out = out.withColumn(f, F.when(given, F.col(f"__u.{f}")).otherwise(F.col(f)))
    return out.withColumn("human_reviewed", given | F.coalesce("human_reviewed", F.lit(False))).drop("__u")


def unreviewed(golden: DataFrame) -> DataFrame:
    return golden.filter(~F.coalesce("human_reviewed", F.lit(False)))


def reviewed(golden: DataFrame) -> DataFrame:
    return golden.filter(F.coalesce("human_reviewed", F.lit(False)))


def progress(golden: DataFrame) -> DataFrame:
    done = F.count_if(F.coalesce("human_reviewed", F.lit(False)))
    return golden.agg(
        F.count("*").alias("total"), done.alias("reviewed"),
        F.round(done / F.greatest(F.count("*"), F.lit(1)) * 100, 2).alias("reviewed_pct"),
    )


def annotation_template(answers: DataFrame, id_col: str = "id") -> DataFrame:
    """Sheet for human ratings, numbered 1..n in id order.

    """
    empty = ["relevance", "groundedness", "correctness", "helpfulness", "brand_consistency", "safety",
             "escalation_appropriateness", "overall", "notes"]
    numbered = number_rows(answers.select(id_col, "customer_message", "generated_response"), id_col)
    return numbered.select(
        F.col("row_no").alias("id"), "customer_message", "generated_response",
        *[F.lit("").alias(f"human_{c}") for c in empty],
        F.lit(False).alias("annotated"), F.lit("").alias("annotator"),
    )
