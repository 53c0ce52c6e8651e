import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.config import UNCONFIGURED_LIMITS, EscalationLimits
from threadloom.functions import rules
from threadloom.operators import contract, decisions, golden, metrics
from threadloom.sources import tables


def decide(spark, text, conf, best, gen=False, reason=None, limits=EscalationLimits()):
    df = spark.createDataFrame(
        [(text, conf, best, gen, reason)],
        "text string, intent_confidence double, best_score double, generator_escalates boolean, generator_reason string",
    )
    return decisions.decide(df, limits).first()


@pytest.mark.parametrize("text,conf,best,gen,source", [
    ("How do I change my plan?", 0.9, 0.8, False, "policy_and_confidence_gate"),
    ("can you connect me with a human", 0.95, 0.9, False, "explicit_human_request"),
    ("talk to a person about fraud", 0.1, None, True, "explicit_human_request"),
    ("My account was hacked and unauthorized charges were made", 0.9, 0.8, False, "sensitive_content"),
    ("My issue is solved", 0.9, 0.8, False, "sensitive_content"),
    ("hello", 0.3, 0.9, False, "low_intent_confidence"), ("hello", None, 0.9, False, "low_intent_confidence"),
    ("hello", 0.85, 0.15, False, "insufficient_evidence"), ("hello", 0.85, None, False, "insufficient_evidence"),
    ("hello", 0.9, 0.9, True, "llm_recommendation"), (None, 0.9, 0.9, None, "policy_and_confidence_gate"),
])
def test_precedence(spark, text, conf, best, gen, source):
    got = decide(spark, text, conf, best, gen)
    assert got["decision_source"] == source
    assert got["escalation_score"] == rules.SCORES[source]
    assert got["should_escalate"] == (source != "policy_and_confidence_gate")
    assert (got["escalation_reason"] is None) == (not got["should_escalate"])


def test_reasons(spark):
    assert decide(spark, "hello", 0.3, 0.9)["escalation_reason"] == "Low intent confidence (0.30 < threshold 0.4)"
    assert decide(spark, "hello", 0.9, 0.15)["escalation_reason"] == "Low retrieval quality (best similarity: 0.15 < 0.3)"
    assert decide(spark, "a lawsuit, fraud", 0.9, 0.9)["escalation_reason"] == "Sensitive keywords detected: lawsuit, fraud"
    assert decide(spark, "hi", 0.9, 0.9, True, "two answers")["escalation_reason"] == "two answers"


def test_unconfigured_limits(spark):
    assert decide(spark, "hello", 0.42, 0.9)["decision"] == rules.AUTO
    assert decide(spark, "hello", 0.42, 0.9, limits=UNCONFIGURED_LIMITS)["decision"] == rules.ESCALATE


def test_hits_decide_without_generator(spark):
    msgs = spark.createDataFrame([(1, "hello", 0.9), (2, "hello", 0.9), (3, "hello", 0.9)], "id bigint, text string, intent_confidence double")
    hits = spark.createDataFrame([(1, 7, 0.2), (1, 8, 0.9), (2, 7, 0.1)], "q_id bigint, d_id bigint, score double")
    got = {r["id"]: r["decision_source"] for r in decisions.decide_with_hits(msgs, hits).collect()}
    assert got == {1: "policy_and_confidence_gate", 2: "insufficient_evidence", 3: "insufficient_evidence"}


def test_classification(spark):
    df = spark.createDataFrame(list(zip("abacb", "ababb")), "truth string, prediction string")
    got = metrics.classification(df).first()
    assert got["accuracy"] == pytest.approx(0.8)
    assert got["macro_f1"] == pytest.approx((1 + 0.8 + 0) / 3)
    assert {r["label"]: r["support"] for r in metrics.per_class(df).collect()} == {"a": 2, "b": 2, "c": 1}
    matrix = {(r["truth"], r["prediction"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert len(matrix) == 9 and matrix["c", "b"] == 1 and matrix["c", "c"] == 0
    assert metrics.confusion_matrix(df, ["a", "b"]).count() == 4


def test_escalation_metrics(spark):
    df = spark.createDataFrame([(True, True), (False, False), (True, False), (False, False)], "truth boolean, prediction boolean")
    got = metrics.escalation_metrics(df).first()
    assert (got["accuracy"], got["escalation_precision"], got["escalation_recall"]) == (0.75, 1.0, 0.5)


def test_agreement_edge_cases(spark):
    rows = [("flat", i, 3.0, float(i)) for i in range(1, 6)] + [("few", i, 1.0, 2.0) for i in range(2)]
    rows += [("up", i, float(i), float(i * i)) for i in range(1, 6)] + [("up", 9, None, 4.0)]
    df = spark.createDataFrame(rows, "dim string, item_id int, human double, judge double")
    got = {r["dim"]: r for r in metrics.with_p_value(metrics.agreement(df)).collect()}
    assert set(got) == {"flat", "up"}
    assert got["flat"]["pearson_r"] == 0.0 and got["flat"]["spearman_r"] is None
    assert got["up"]["spearman_r"] == pytest.approx(1.0) and got["up"]["n_samples"] == 5 and got["up"]["spearman_p"] == pytest.approx(0, abs=1e-6)


def tail_by_density(r, n):
    """Two-sided tail of Student's t by summing its density over the middle part."""
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    x = np.linspace(-t, t, 400_001)
    return 1 - np.trapezoid(const * (1 + x * x / df) ** (-(df + 1) / 2), x)


@pytest.mark.parametrize("r,n", [(0.5, 10), (0.3, 100), (-0.9, 5), (0.0, 20), (0.05, 3000), (0.04, 9000)])
def test_p_values(r, n):
    assert metrics.two_sided_p(r, n) == pytest.approx(tail_by_density(r, n), abs=2e-6 if n < 5000 else 2e-5)
    assert math.isnan(metrics.two_sided_p(0.5, 2))


def test_contract_cases(spark):
    cols = contract.CONTRACT_A.required
    one = spark.createDataFrame([("c1", "b", "msg", "rep", "t", "", "u", "s", 2)], ",".join(f"{c} {'bigint' if c == 'conversation_length' else 'string'}" for c in cols))
    valid = lambda df: contract.is_valid(contract.check(df, contract.CONTRACT_A)).first()["valid"]
    assert valid(one)
    assert not valid(one.drop("brand"))
    assert not valid(one.filter("false"))
    assert not valid(one.withColumn("brand", F.lit(None).cast("string")))


def test_leakage_cases(spark):
    s = "conversation_id int, customer_message string, customer_author string"
    train = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], s)
    found = lambda test: {r["column"]: r["leak"] for r in contract.leakage(train, spark.createDataFrame(test, s)).collect()}
    assert found([(3, "d", "q"), (4, "e", "q")])["conversation_id"]
    clean = found([(4, "d", "x"), (5, "e", "q")])
    assert not any(clean.values())
    assert found([(4, "a", "q")])["customer_message"]


def test_updates(spark):
    gold = spark.createDataFrame(
        [(1, None, None, None, None, False), (2, None, None, None, None, None)],
        "conversation_id int, human_intent string, human_escalation boolean, human_reason string, reviewer_notes string, human_reviewed boolean",
    )
    ups = spark.createDataFrame(
        [(1, "late", True, "r", None, 2), (1, "early", False, "q", "n", 1)],
        "conversation_id int, human_intent string, human_escalation boolean, human_reason string, reviewer_notes string, seq int",
    )
    out = golden.apply_updates(gold, ups, "seq")
    assert {(r["conversation_id"], r["human_intent"], r["human_reviewed"]) for r in out.collect()} == {(1, "late", True), (2, None, False)}
    assert golden.progress(out).first()["reviewed_pct"] == 50.0
    with pytest.raises(KeyError):
        golden.apply_updates(gold, ups.withColumn("conversation_id", F.lit(7)), "seq")


def test_csv_keeps_newlines_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'two\nlines, "quoted"'), (2, "plain")], "id bigint, text string")
    tables.write_csv(df, str(tmp_path / "x"))
    assert sorted(tables.read_csv(spark, str(tmp_path / "x"), df.schema).collect()) == sorted(df.collect())


def test_missing_table_format_is_skipped(spark, tmp_path):
    df = spark.range(3)
    assert not tables.write_table_format(df, str(tmp_path / "d"), "no_such_format")
    assert tables.write_table_format(df, str(tmp_path / "p"), "parquet")
