"""Quick evaluation: classification, approaches, retrieval and escalation in one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import metrics, retrieval


def _rows(df: DataFrame, section: str, name_col: str | None = None) -> DataFrame:
    cols = [c for c in df.columns if c != name_col]
    label = F.concat(F.col(name_col), F.lit(".")) if name_col else F.lit("")
    cells = [F.struct(F.concat(label, F.lit(c)).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols]
    return df.select(F.explode(F.array(*cells)).alias("x")).select(F.lit(section).alias("section"), "x.*")


def quick_report(
    predictions: DataFrame | None = None, approaches: DataFrame | None = None, hits: DataFrame | None = None,
    flagged_hits: DataFrame | None = None, n_relevant: DataFrame | None = None, decisions: DataFrame | None = None,
) -> DataFrame:
    """(section, metric, value) for the parts that are given."""
    parts = []
    if predictions is not None:
        parts.append(_rows(metrics.classification(predictions), "intent"))
    if approaches is not None:
        parts.append(_rows(metrics.compare_approaches(approaches), "approach", "approach"))
    if hits is not None:
        parts.append(_rows(retrieval.mean_top_score(hits), "retrieval"))
    if flagged_hits is not None and n_relevant is not None:
        parts.append(_rows(retrieval.retrieval_metrics(flagged_hits, n_relevant), "retrieval"))
    if decisions is not None:
        parts.append(_rows(metrics.escalation_summary(decisions), "escalation"))
    return reduce(DataFrame.unionByName, parts)
