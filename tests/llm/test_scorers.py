import numpy as np

import __spark_entry__ as entry
from threadloom.llm import hashed, quality, toxicity

MORE = "0.1"


def test_pairs_beyond_weights():
    """Toxic only if both terms meet: no additive score can say so."""
    rng = np.random.default_rng(0)
    rows = [sorted({*rng.integers(2, 40, 6).tolist(), *([0] if rng.random() < 0.5 else []), *([1] if rng.random() < 0.5 else [])}) for _ in range(3000)]
    y = np.array([float(0 in r and 1 in r) for r in rows])
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ids = np.concatenate(rows)
    machine = hashed.train(starts, ids, np.ones(len(ids)), y, 64, 4, epochs=20, rate=0.3)
    assert ((machine.margins(starts, ids, np.ones(len(ids))) > 0) == y).mean() > 0.99
    assert machine.factors[0] @ machine.factors[1] > 1


def test_toxicity_on_rows_set_aside(spark, data_dir):
    folder = data_dir.replace("0.001", MORE)
    scored = {r.doc_id: r for r in entry.queries()["op5_toxicity"](spark, folder).collect()}
    assert len(scored) == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if scored[r.doc_id].held_out]
    right = [scored[r.doc_id].predicted == r.toxic for r in labels]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in scored.values())
    assert np.mean([scored[r.doc_id].predicted for r in labels if r.toxic]) > 0.7


def test_quality_against_labels_never_read(spark, data_dir):
    folder = data_dir.replace("0.001", MORE)
    kept = {r.doc_id: r.kept for r in entry.queries()["op7_quality"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    assert np.mean([kept[r.doc_id] for r in labels if r.quality == 1]) > 0.99
    assert np.mean([not kept[r.doc_id] for r in labels if r.quality == 0]) > 0.97


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    votes = ["".join("-" if rng.random() < 0.3 else "gb"[int((rng.random() < a) != t)] for a in (0.95, 0.8, 0.75, 0.7)) for t in truth]
    counts = {v: votes.count(v) for v in set(votes)}
    posterior = quality.estimate(counts)
    assert np.mean([(posterior[v] >= 0.5) == t for v, t in zip(votes, truth)]) > 0.9
    assert posterior["gbbb"] > 0.5 > posterior["bgg-"] or posterior["gbb-"] > 0.5
    assert quality.estimate({}) == {}


def test_odd_documents(spark, odd_docs, no_docs):
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and all((r.text or "").strip() for r in kept.collect())
    assert quality.keep_good(no_docs).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 0), (99, 1)], "doc_id long, toxic int")
    for docs in (odd_docs, no_docs):
        for marks in (labels, labels.limit(0)):
            scored = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
            assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
