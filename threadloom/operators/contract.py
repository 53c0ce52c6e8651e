"""Data contracts and train/test leakage, as rows of findings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

FINDING = "severity string, check string, column string, n bigint, value double"


@dataclass(frozen=True)
class Contract:
    required: tuple[str, ...]
    critical: tuple[str, ...]
    optional: tuple[str, ...] = ()
    types: dict[str, type] = field(default_factory=dict)
    error_above: float = 5.0
    warn_above: float = 0.0
    check_blanks: bool = True
    id_column: str | None = "conversation_id"
    stats: bool = True


# --- fixed values: the two contracts -------------------------------------
CONTRACT_A = Contract(
    required=("conversation_id", "brand", "customer_message", "historical_support_response", "timestamp",
              "conversation_context", "customer_author", "support_author", "conversation_length"),
    critical=("conversation_id", "brand", "customer_message", "historical_support_response"),
)
CONTRACT_B = Contract(
    required=("conversation_id", "brand", "customer_message", "historical_support_response", "timestamp"),
    critical=("conversation_id", "brand", "customer_message", "historical_support_response", "timestamp"),
    optional=("conversation_context", "customer_author", "support_author", "parent_tweet_id", "response_tweet_id",
              "conversation_length", "is_escalation", "intent", "metadata"),
    types={"conversation_length": T.NumericType, "is_escalation": T.BooleanType},
    error_above=50.0, warn_above=5.0, check_blanks=False, id_column=None, stats=False,
)


def missing_columns(df: DataFrame, contract: Contract) -> list[str]:
    """Required columns the table lacks, from its schema alone."""
    return [c for c in contract.required if c not in df.columns]


def missing_cells(df: DataFrame, contract: Contract) -> DataFrame:
    """(column, n): required columns the table lacks, with the number of rows that go without."""
    lacking = F.array(*[F.lit(c) for c in missing_columns(df, contract)]).cast("array<string>")
    return df.agg(F.count("*").alias("n")).select(F.explode(lacking).alias("column"), "n")


def _row(severity, check: str, column: str | None, n: Column, value: Column | None = None) -> Column:
    return F.struct(
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        F.lit(check).alias("check"),
        F.lit(column).cast("string").alias("column"),
        n.cast("bigint").alias("n"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
    )


def _explode(agg: DataFrame, rows: list[Column]) -> DataFrame:
    return agg.select(F.explode(F.array(*rows)).alias("f")).select("f.*").filter(F.col("severity").isNotNull())


def schema_findings(df: DataFrame, contract: Contract) -> DataFrame:
    """Findings that need no data: missing, present and wrongly typed columns."""
    spark = df.sparkSession
    rows = [("error", "missing_column", c, 1, None) for c in missing_columns(df, contract)]
    rows += [("info", "optional_present", c, 1, None) for c in contract.optional if c in df.columns]
    for name, kind in contract.types.items():
        if name in df.columns and not isinstance(df.schema[name].dataType, kind):
            rows.append(("warning", "wrong_type", name, 1, None))
    return spark.createDataFrame(rows, FINDING)


def check(df: DataFrame, contract: Contract) -> DataFrame:
    """All findings: (severity, check, column, n, value); `value` is a percentage or a statistic.

    Nulls, blanks and length statistics come from one aggregate without distinct
    counts; duplicate ids and brands are counted by their own narrow scans.
    """
    critical = [c for c in contract.critical if c in df.columns]
    total = F.col("total")
    aggs = [F.count("*").alias("total")]
    for c in critical:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
        aggs.append(F.count_if(F.col(c).cast("string") == "").alias(f"blank_{c}"))
    has_length = contract.stats and "conversation_length" in df.columns
    has_message = contract.stats and "customer_message" in df.columns
    if has_length:
        aggs += [F.avg("conversation_length").alias("mean_len"), F.max("conversation_length").alias("max_len")]
    if has_message:
        aggs.append(F.avg(F.length("customer_message")).alias("mean_chars"))

    filled = total > 0
    rows = [_row("info", "rows", None, total), _row(F.when(~filled, "error"), "empty_table", None, F.lit(1))]
    for c in critical:
        n = F.col(f"null_{c}")
        pct = n / F.greatest(total, F.lit(1)) * 100
        severity = F.when(pct > contract.error_above, "error").when(pct > contract.warn_above, "warning")
        rows.append(_row(severity, "nulls", c, n, pct))
        if contract.check_blanks:
            blank = F.col(f"blank_{c}")
            rows.append(_row(F.when(blank > 0, "warning"), "blanks", c, blank))
    if has_length:
        rows.append(_row(F.when(filled, "info"), "mean_length", "conversation_length", F.lit(None), F.col("mean_len")))
        rows.append(_row(F.when(filled, "info"), "max_length", "conversation_length", F.col("max_len")))
    if has_message:
        rows.append(_row(F.when(filled, "info"), "mean_chars", "customer_message", F.lit(None), F.col("mean_chars")))
    parts = [schema_findings(df, contract), _explode(df.agg(*aggs), rows)]

    if contract.id_column in df.columns:
        extra = df.groupBy(contract.id_column).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
        parts.append(_explode(extra, [_row(F.when(F.col("n") > 0, "warning"), "duplicates", contract.id_column, F.col("n"))]))
    if contract.stats and "brand" in df.columns:
        brands = df.filter(F.col("brand").isNotNull()).select("brand").distinct().agg(F.count("*").alias("n"))
        parts.append(_explode(brands, [_row("info", "brands", "brand", F.col("n"))]))
    return reduce(DataFrame.unionByName, parts)


def is_valid(findings: DataFrame) -> DataFrame:
    return findings.agg((F.count_if(F.col("severity") == "error") == 0).alias("valid"))


def violations(conversations: DataFrame) -> DataFrame:
    """Ids of rows without message, reply or brand; must be empty."""
    return conversations.filter(
        F.col("customer_message").isNull() | F.col("historical_support_response").isNull() | F.col("brand").isNull()
    ).select("conversation_id")


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values occurring on both sides."""
    return a.select(column).filter(F.col(column).isNotNull()).intersect(b.select(column))


def leakage(train: DataFrame, test: DataFrame, message_pct: float = 1.0) -> DataFrame:
    """Overlap of ids, messages and authors between both sets.

    Any shared id and more than `message_pct` percent of shared messages leak;
    authors are reported only. One shuffle serves all columns and both sides.
    """
    columns = [c for c in ("conversation_id", "customer_message", "customer_author") if c in train.columns and c in test.columns]

    def long(df: DataFrame, side: int) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
        return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*", F.lit(side).alias("side"))

    per_value = (
        long(train, 0).unionByName(long(test, 1)).filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg((F.min("side") == 0).alias("in_train"), (F.max("side") == 1).alias("in_test"))
    )
    pct = F.coalesce(F.try_divide(F.col("overlap") * 100.0, F.col("test_distinct")), F.lit(0.0))
    return (
        per_value.groupBy("column")
        .agg(F.count_if(F.col("in_train") & F.col("in_test")).alias("overlap"), F.count_if("in_test").alias("test_distinct"))
        .withColumn("pct", pct)
        .withColumn(
            "leak",
            F.when(F.col("column") == "conversation_id", F.col("overlap") > 0)
            .when(F.col("column") == "customer_message", F.col("pct") > message_pct)
            .otherwise(False),
        )
    )
