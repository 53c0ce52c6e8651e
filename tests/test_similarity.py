import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.config import TermSettings
from threadloom.functions import rules, vectors as vec
from threadloom.operators import baselines, features, retrieval, similarity

DIM = 8


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    m = rng.normal(size=(300, DIM))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[100:200] = m[100]  # a third of all rows are copies
    return m


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id bigint, vector array<double>").repartition(5)


def brute(data, k, skip_same):
    s = np.round(data @ data.T, 9)
    out = set()
    for q in range(len(data)):
        order = sorted((-s[q, d], d) for d in range(len(data)) if not (skip_same and q == d))[:k]
        out |= {(q, d, r) for r, (_, d) in enumerate(order, 1)}
    return out


@pytest.mark.parametrize("limit", [similarity.BROADCAST_BYTES, 8000])
@pytest.mark.parametrize("skip_same", [True, False])
def test_exact_top_k(table, data, limit, skip_same):
    got = similarity.exact_top_k(table, table, 4, DIM, skip_same, broadcast_bytes=limit).collect()
    assert {(r["q_id"], r["d_id"], r["rank"]) for r in got} == brute(data, 4, skip_same)


def test_more_results_than_documents(table):
    few = table.filter("id < 3")
    got = similarity.exact_top_k(table.filter("id = 9"), few, 10, DIM).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3]


def test_floor_drops_low_scores(table):
    assert similarity.exact_top_k(table, table, 5, DIM, floor=0.9).filter("score < 0.9").isEmpty()


@pytest.mark.parametrize("limit", [similarity.BROADCAST_BYTES, 8000])
def test_cell_search(spark, table, data, tmp_path, limit):
    index = similarity.build_cells(table.withColumn("vector", F.col("vector").cast("array<float>")), 20)
    index.save(str(tmp_path / "i"))
    index = similarity.CellIndex.load(spark, str(tmp_path / "i"))
    got = index.search(table.withColumn("vector", F.col("vector").cast("array<float>")), 4, 10, skip_same=False, broadcast_bytes=limit).collect()
    ranks = Counter(r["q_id"] for r in got)
    assert set(ranks.values()) == {4}
    scores = {(r["q_id"], r["d_id"]): r["score"] for r in got}
    assert all(abs(s - data[q] @ data[d]) < 1e-5 for (q, d), s in scores.items())
    # the query itself, or a copy of it, is the best match
    assert all(r["score"] > 0.9999 for r in got if r["rank"] == 1)


def test_documents_are_not_copied_for_each_block_of_queries(spark, table):
    """Beyond a share for each core, what a slot holds is copied once, however many queries there are."""
    few, many = table.limit(50), table.crossJoin(spark.range(20).withColumnRenamed("id", "copy")).drop("copy")
    copies = [similarity.held_grid(q, table, 300 * 72, 2000, 4)[1].count() for q in (few, many)]
    assert copies == [300, 300]
    index = similarity.CellIndex(np.eye(DIM), table.withColumn("cell", F.lit(0)))
    asked, held = index._sent_to_cells(many, 1, query_rows=10_000)
    assert held.count() == 300 * held.select("slot").distinct().count()


@pytest.mark.parametrize("skip_same", [True, False])
@pytest.mark.parametrize("floor", [None, 0.5])
def test_held_documents_by_brute_force(data, skip_same, floor):
    """More documents than a block, a third of them alike, ids from one to 900."""
    docs = np.concatenate([data, data[::-1], data * 0.5])
    ids = np.arange(1, len(docs) + 1)
    q, d, s = similarity._held_top_k(ids[:300], data, ids, docs, 4, skip_same, floor)
    scores, want = np.round(data @ docs.T, 9), {}
    for i in range(300):
        order = sorted((-x, j) for x, j in zip(scores[i], ids) if not (skip_same and j == i + 1) and (floor is None or x >= floor))
        want[i + 1] = [j for _, j in order[:4]]
    got = {i + 1: [] for i in range(300)}
    for a, b in zip(q, d):
        got[a].append(b)
    assert got == want


def test_normalise(spark):
    got = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(vec.normalise(F.col("v")).alias("u")).collect()
    assert [list(r["u"]) for r in got] == [[0.6, 0.8], [0.0, 0.0]]


# ------------------------------------------------------------------- TF-IDF

TEXTS = [
    "Login fails on my phone, login again", "The song skips and the song stops", "Password reset for my account please",
    "song song song", "", None, "zebra", "Login to my account fails again",
]


def brute_terms(text):
    import re

    w = [x for x in re.findall(r"\w{2,}", (text or "").lower()) if x not in rules.ENGLISH_STOP_WORDS]
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def brute_tfidf(texts, settings):
    docs = [brute_terms(t) for t in texts]
    df, cf = Counter(), Counter()
    for d in docs:
        df.update(d.keys())
        cf.update(d)
    n = len(texts)
    kept = sorted((t for t in df if settings.min_df <= df[t] <= settings.max_df * n), key=lambda t: (-cf[t], t))[: settings.max_features]
    rows = []
    for d in docs:
        w = {t: (1 + math.log(c) if settings.sublinear else c) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in d.items() if t in kept}
        length = math.sqrt(sum(x * x for x in w.values()))
        rows.append({t: x / length for t, x in w.items()})
    return sorted(kept), rows


@pytest.mark.parametrize("settings", [TermSettings(1, 1.0, 100, False), TermSettings(2, 0.5, 6, True)])
def test_tfidf(spark, settings):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    model = features.fit_terms(df, "id", "text", settings)
    kept, want = brute_tfidf(TEXTS, settings)
    assert list(model.table["term"]) == kept
    got = model.transform(df, "id", "text").orderBy("id").collect()
    assert len(got) == len(TEXTS)
    for row, w in zip(got, want):
        assert {kept[i]: pytest.approx(v) for i, v in zip(row["indices"], row["values"])} == w


def test_nearest_reply(spark):
    history = spark.createDataFrame([(i, t, f"reply {i}") for i, t in enumerate(TEXTS)], "id bigint, text string, reply string")
    asks = spark.createDataFrame([(1, "my login fails again"), (2, "quite unknown words"), (3, "song")], "id bigint, text string")
    got = {r["id"]: r for r in baselines.nearest_reply(asks, history, TermSettings(1, 1.0, 100)).collect()}
    assert got[1]["reply"] in ("reply 0", "reply 7") and not got[1]["should_escalate"]
    assert got[2]["reply"] == "" and got[2]["should_escalate"] and got[2]["confidence"] == 0
    assert got[3]["similar_id"] == 3


def test_rare_terms_everywhere(spark):
    """One term in every document: no posting list is joined, results stay whole."""
    rng = random.Random(5)
    texts = [f"common w{rng.randint(0, 30)} w{rng.randint(0, 30)}" for _ in range(400)]
    history = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], "id bigint, text string, reply string")
    asks = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:40])], "id bigint, text string")
    settings = TermSettings(1, 1.0, 5000)
    got = {(r["q_id"], r["rank"]): (r["d_id"], r["score"]) for r in baselines.similar_history(asks, history, 3, settings).collect()}
    _, rows = brute_tfidf(texts, settings)
    for q in range(40):
        s = sorted((-round(sum(w * rows[d].get(t, 0) for t, w in rows[q].items()), 9), d) for d in range(400))[:3]
        assert [got[q, r][0] for r in (1, 2, 3)] == [d for _, d in s]


def test_rerank_uses_base_threshold_and_ties(spark):
    q = spark.createDataFrame([(1, "login fails", "account_access")], "id bigint, text string, intent string")
    d = spark.createDataFrame(
        [(10, "login fails", "r"), (11, "nothing", "r"), (12, "nothing", "your password"), (13, "login fails", "r")],
        "id bigint, text string, reply string",
    )
    hits = spark.createDataFrame([(1, 11, 0.5, 1), (1, 12, 0.46, 2), (1, 10, 0.42, 3), (1, 13, 0.34, 4)], "q_id bigint, d_id bigint, score double, rank int")
    got = retrieval.rerank(hits, q, d).orderBy("rank").collect()
    assert [r["d_id"] for r in got] == [10, 12, 11]
    assert got[0]["score"] == pytest.approx(0.42 + 0.05 + 0.05) and got[1]["score"] == pytest.approx(0.51)


def test_retrieval_metrics(spark):
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1), (2, 8, 2)], "q_id bigint, d_id bigint, rank int")
    relevant = spark.createDataFrame([(1, 6), (1, 9), (2, 7)], "q_id bigint, d_id bigint")
    n = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "q_id bigint, n bigint")
    got = retrieval.retrieval_metrics(retrieval.flag_relevant(hits, relevant), n, ks=(1, 3)).first()
    assert got["recall_at_1"] == pytest.approx(0.5) and got["precision_at_1"] == pytest.approx(1 / 3)
    assert got["recall_at_3"] == pytest.approx(0.75) and got["precision_at_3"] == pytest.approx((0.5 + 0.5 + 0) / 3)
    assert got["mrr"] == pytest.approx((0.5 + 1 + 0) / 3)


@pytest.mark.parametrize("sent", [0, similarity.SENT_BYTES])
def test_probing_every_cell_copies_no_query_to_cells(table, data, monkeypatch, sent):
    monkeypatch.setattr(similarity, "SENT_BYTES", sent)
    monkeypatch.setattr(similarity.CellIndex, "_sent_to_cells", None)
    monkeypatch.setattr(similarity.CellIndex, "_scan", None)
    index = similarity.build_cells(table, 6)
    got = index.search(table, 4, 6, skip_same=True).collect()
    assert {(r["q_id"], r["d_id"], r["rank"]) for r in got} == brute(data, 4, True)


@pytest.mark.parametrize("most", [0, 3, 256])
def test_frequent_terms_are_held_densely(monkeypatch, most):
    """Few lists are left to look up, and near ties are told apart as by whole products."""
    monkeypatch.setattr(similarity, "DENSE_TERMS", most)
    rng, dim, n = np.random.default_rng(3), 12, 300
    x = rng.random((n, dim)) * (rng.random((n, dim)) < np.linspace(0.9, 0.02, dim))
    x[7], x[100:140] = 0, x[50] * (1 + 1e-8 * rng.random((40, 1)))
    row, idx = np.nonzero(x)
    lengths, ends = np.bincount(row, minlength=n), np.r_[0, np.cumsum(np.bincount(row, minlength=n))]
    held = similarity._Posted.of(np.arange(n) * 2, lengths, idx, x[row, idx], dim)
    assert len(held.rows) == sum(sorted((x > 0).sum(axis=0))[: dim - min(most, dim)])
    dense = held.dense_sums(lengths, idx, x[row, idx])
    scores = np.round(x @ x.T, 9)
    np.fill_diagonal(scores, -1)
    for q in range(n):
        at = slice(ends[q], ends[q + 1])
        d, s = similarity._posted_top_k(2 * q, idx[at], x[q, idx[at]], dense[q], held, 3, True, 1e-9)
        want = [i for i in np.argsort(-scores[q], kind="stable")[:3] if scores[q, i] >= 1e-9]
        assert s == pytest.approx(scores[q, want], abs=1.1e-9) and len(d) == len(want)
        assert [scores[q, i // 2] for i in d] == pytest.approx(scores[q, want], abs=1.1e-9)


def test_words_of_a_document_are_cut_before_it_meets_queries(spark):
    """A document is in many pools: no expression above the joins cuts its text."""
    d = spark.createDataFrame([(i, "login fails", "r") for i in range(3)], "id bigint, text string, reply string")
    hits = spark.createDataFrame([(0, 1, 0.5, 1), (2, 1, 0.5, 1)], "q_id bigint, d_id bigint, score double, rank int")
    plan = retrieval.rerank(hits, d.withColumn("intent", F.lit("x")), d)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.rindex("Join")]
    assert "regexp_extract_all" not in above.split("Join")[0] and "regexp_extract_all" in plan
