import random

import pytest
from pyspark.sql import Window, functions as F

from threadloom.functions import ranking
from threadloom.operators import golden, intents


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows carry one label."""
    label = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string")))
    return spark.range(4000).select("id", label.alias("label"), ranking.hash_order(F.col("id")).alias("h"))


@pytest.mark.parametrize("small", [1, 10, 1000])
def test_cuts_are_the_rows_of_a_plain_window(spark, skewed, small):
    rows = skewed.unionByName(spark.range(5000, 5040).select("id", F.lit(None).cast("string").alias("label"), ranking.hash_order(F.col("id")).alias("h")))
    quotas = rows.groupBy("label").agg(F.when(F.col("label") == "k1", 1).when(F.col("label") == "k3", F.count("*")).when(F.col("label") == "k5", 10**6).otherwise(F.ceil(F.count("*") / 3)).alias("quota"))
    w = Window.partitionBy("label").orderBy("h", "id")
    plain = rows.withColumn("rn", F.row_number().over(w)).join(quotas.withColumnRenamed("label", "l"), F.col("label").eqNullSafe(F.col("l"))).filter("rn = quota").select("label", "h", "id")
    found = ranking.hash_cuts(rows, quotas, "label", "h", "id", small).select("label", "cut.h", F.col("cut.t").alias("id"))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect())) and found.count() == 8


def test_cuts_with_repeated_rows(spark):
    rows = spark.range(300).select(F.lit("x").alias("g"), F.lit("00" * 16).alias("h"), (F.col("id") % 3).alias("id"))
    found = ranking.hash_cuts(rows, spark.createDataFrame([("x", 150)], "g string, quota bigint"), "g", "h", "id", 10).first()
    assert found.cut.t == 1


def test_top_per_group_equals_a_plain_window(skewed):
    w = Window.partitionBy("label").orderBy("h", "id")
    plain = skewed.withColumn("rn", F.row_number().over(w)).filter("rn <= 25").select("id", "rn")
    ours = ranking.top_per_group(skewed, ["label"], [F.col("h"), F.col("id")], 25, salt=F.col("id")).select("id", "rn")
    assert ours.exceptAll(plain).isEmpty() and ours.count() == plain.count()


@pytest.mark.parametrize("rows_each", [7, 100, 10**6])
def test_number_rows(spark, rows_each):
    ids = [i * i for i in range(500)]
    df = spark.createDataFrame([(i,) for i in random.Random(1).sample(ids, len(ids))], "id bigint")
    numbered = ranking.number_rows(df, "id", rows_each)
    assert [r["row_no"] for r in numbered.orderBy("id").collect()] == list(range(1, 501))
    assert ranking.number_rows(df.limit(0), "id", rows_each).count() == 0


def test_long_texts_are_numbered_in_more_ranges(spark, monkeypatch):
    """What a task sorts is bounded by bytes, not by rows alone."""
    ranges, staged = [], ranking.staged

    def counted(df, name):
        ranges.append(df.rdd.getNumPartitions())
        return staged(df, name)

    monkeypatch.setattr(ranking, "staged", counted)
    df = spark.range(400).select((F.col("id") * 3).alias("id"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("é"), 500)).alias("text"))
    numbered = ranking.number_rows(df, "id", bytes_each=50_000)
    assert ranges[0] >= 6
    assert [(r["row_no"], r["id"]) for r in numbered.orderBy("id").collect()] == [(i + 1, 3 * i) for i in range(400)]


def test_split_shares_are_exact(skewed):
    got = intents.stratified_split(skewed.drop("h"), "id", "label").groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t"))
    assert all(r["t"] == int(r["n"] * 0.2 + 0.5) for r in got.collect())


def reference_allocation(counts, target):
    """Plain loop over strata, largest first."""
    floor = max(5, target // (len(counts) * 3))
    total = sum(counts.values())
    order = sorted(counts, key=lambda k: (-counts[k], k))
    plan = {k: min(max(floor, target * counts[k] // total), counts[k]) for k in order}
    left = target - sum(plan.values())
    for k in order:
        if left > 0:
            plan[k] += min(left, 5)
            left -= min(left, 5)
    return plan


def test_allocation(spark):
    rng = random.Random(3)
    for _ in range(6):
        counts = {f"i{j}": rng.choice([1, 3, 20, 400, 9000]) for j in range(rng.randint(2, 12))}
        target = rng.choice([20, 100, 200])
        df = spark.createDataFrame(list(counts.items()), "intent string, c bigint")
        assert {r["intent"]: r["n"] for r in golden.allocate(df, target).collect()} == reference_allocation(counts, target)


def test_golden_set_is_disjoint_from_training(spark, skewed):
    conv = skewed.select(F.col("id").alias("conversation_id"), F.repeat(F.lit("word "), (F.col("id") % 60 + 1).cast("int")).alias("customer_message"), F.col("label").alias("intent"))
    gold = golden.build_golden_set(conv, 60)
    ids = {r["conversation_id"] for r in gold.collect()}
    assert len(ids) == 60 and gold.select("true_intent").distinct().count() == 8  # hot and k0..k6
    rest = golden.exclude_golden(conv, gold)
    assert rest.count() == 4000 - 60
    picks = golden.sample_strata(conv, 60).groupBy("intent").count().collect()
    plan = {r["intent"]: r["n"] for r in golden.allocate(conv.groupBy("intent").agg(F.count("*").alias("c")), 60).collect()}
    assert all(r["count"] <= plan[r["intent"]] for r in picks)


def test_one_label_gives_a_random_set(spark):
    conv = spark.range(50).select(F.col("id").alias("conversation_id"), F.lit("some message").alias("customer_message"), F.lit("x").alias("intent"))
    rows = golden.build_golden_set(conv, 20).collect()
    assert len(rows) == 20 and {r["sampling_category"] for r in rows} == {"random"} and {r["true_intent"] for r in rows} == {""}
