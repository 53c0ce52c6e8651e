import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.config import TermSettings
from threadloom.operators import features, golden, intents, metrics, similarity
from threadloom.plans import training, triage
from threadloom.sources import standins as st
from threadloom.streaming import scoring

SETTINGS = TermSettings(2, 0.9, 300, True)


@pytest.fixture(scope="module")
def talk(spark):
    """Four themes with their own words."""
    words = {"billing": "refund charge payment", "music": "song playlist audio", "login": "password account locked", "app": "crash update install"}
    rows = []
    for i in range(240):
        label = list(words)[i % 4]
        w = words[label].split()
        rows.append((i, f"my {w[i % 3]} {w[(i // 3) % 3]} problem number n{i % 11} {w[(i // 5) % 3]}", label))
    return spark.createDataFrame(rows, "conversation_id bigint, customer_message string, intent string")


def test_projection_matches_numpy(spark, talk):
    model = features.fit_terms(talk, "conversation_id", "customer_message", SETTINGS)
    rows = model.stage_rows(talk, "conversation_id", "customer_message")
    basis = intents.fit_projection(rows.sparse(), model.size, 5, rounds=60)
    dense = np.zeros((240, model.size))
    for r in rows.sparse().collect():
        dense[r["conversation_id"], r["indices"]] = r["values"]
    s = np.linalg.svd(dense, compute_uv=False)[:5]
    assert np.linalg.norm(dense @ basis, axis=0) == pytest.approx(s, rel=1e-4)
    out = intents.project(rows.sparse(), "conversation_id", basis).orderBy("conversation_id").collect()
    assert np.array([r["features"].toArray() for r in out]) == pytest.approx(dense @ basis, abs=1e-9)


def test_discovery(spark, talk):
    model, found = intents.discover(talk, "conversation_id", "customer_message", k=4, settings=SETTINGS, components=20)
    rows = found.collect()
    assert sum(r["size"] for r in rows) == 240 and [r["size"] for r in rows] == sorted((r["size"] for r in rows), reverse=True)
    assert all(len(r["terms"]) <= 10 and len(r["examples"]) <= 5 for r in rows)
    got = model.assign(talk, "conversation_id", "customer_message")
    assert got.count() == 240 and set(r["intent"] for r in got.select("intent").distinct().collect()) <= set(model.names.values())


def test_classifier_round_trip(spark, talk, tmp_path):
    classifier, held = intents.train_text_classifier(talk, "conversation_id", "customer_message", "intent", SETTINGS, max_iter=40)
    assert held.count() == 48
    assert held.filter(F.col("truth") == F.col("prediction")).count() >= 46
    classifier.save(spark, str(tmp_path / "c"))
    again = intents.IntentClassifier.load(spark, str(tmp_path / "c"))
    a = {r["conversation_id"]: r for r in classifier.predict(talk, "conversation_id", "customer_message").collect()}
    b = {r["conversation_id"]: r for r in again.predict(talk, "conversation_id", "customer_message").collect()}
    assert len(a) == 240
    for k, r in a.items():
        assert sum(r["probabilities"].values()) == pytest.approx(1)
        assert r["confidence"] == pytest.approx(max(r["probabilities"].values()))
        assert b[k]["intent"] == r["intent"]


def test_training_job(spark, talk, tmp_path):
    vectors = spark.range(240).select("id", F.array(*[F.sin(F.col("id") * (i + 1)).cast("float") for i in range(6)]).alias("vector"))
    out = training.run(
        talk.select("conversation_id", "customer_message"), str(tmp_path), vectors, target=40, k=4,
        discovery=SETTINGS, classification=SETTINGS, baseline=TermSettings(2, 0.9, 300), max_iter=30,
    )
    assert out.labelled.count() == 240
    # all messages are of usual length, so the share kept for unusual ones stays empty
    plan = golden.allocate(out.labelled.groupBy("intent").agg(F.count("*").alias("c")), 40).collect()
    assert sum(r["n"] for r in plan) == 40
    assert out.golden.count() == sum(r["n"] - int(r["n"] * 0.2) for r in plan)
    assert 0 <= out.metrics.first()["accuracy"] <= 1
    assert out.index.documents.count() == 240
    trained_on = set(r["item_id"] for r in out.held_out.select("item_id").collect())
    assert not trained_on & set(r["conversation_id"] for r in out.golden.select("conversation_id").collect())


def test_triage_keeps_every_message(spark):
    docs = spark.createDataFrame([(i, "login fails", f"reply {i}", [1.0, float(i)]) for i in range(5)], "id bigint, text string, reply string, vector array<double>")
    msgs = spark.createDataFrame(
        [(1, "login fails", "account_access", 0.9, [1.0, 0.5]), (2, "nothing near", "other", 0.9, [-1.0, -1.0]), (3, "broken", None, None, [1.0, 1.0])],
        "id bigint, text string, intent string, intent_confidence double, vector array<double>",
    )
    got = {r["id"]: r for r in triage.triage(msgs, docs, 2).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["decision"] == "AUTO_HANDLE" and got[1]["reply"] == "reply 4"
    assert got[2]["decision_source"] == "insufficient_evidence" and got[2]["n_cases"] == 0
    assert got[3]["decision_source"] == "low_intent_confidence"


def test_stream_equals_batch_and_replays_are_harmless(spark, data_dir, tmp_path):
    requests = st.requests(st.tweets(spark, data_dir)).select("tweet_id", "text", "intent_confidence", "best_score")
    source = str(tmp_path / "in")
    requests.repartition(3).write.parquet(source)
    arriving = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink = str(tmp_path / "out")
    scoring.start(arriving, sink, str(tmp_path / "state")).awaitTermination()
    batch = scoring.score(requests).select("tweet_id", "decision_source").collect()
    streamed = lambda: sorted(spark.read.parquet(sink).select("tweet_id", "decision_source").collect())
    assert streamed() == sorted(batch)
    # a second start on the same state has nothing to do, a fresh state writes the same batches again
    scoring.start(arriving, sink, str(tmp_path / "state")).awaitTermination()
    scoring.start(arriving, sink, str(tmp_path / "state2")).awaitTermination()
    assert streamed() == sorted(batch)


def test_exact_unless_an_index_is_given(spark):
    v = spark.range(30).select("id", F.array(F.cos("id").cast("float"), F.sin("id").cast("float")).alias("vector"))
    assert similarity.top_k(v, v, 3, 2).count() == 90
    assert similarity.top_k(v, v, 1, 2, similarity.build_cells(v, 4), probe=2).count() == 30


def test_unusable_vectors_escalate(spark):
    """Null, NaN, null cells and wrong lengths, among messages and among documents."""
    bad = [None, [float("nan"), 1.0], [None, 1.0], [1.0, 2.0, 3.0], []]
    docs = spark.createDataFrame(
        [(i, "login fails", f"reply {i}", [1.0, float(i)]) for i in range(5)] + [(10 + i, "login fails", "never", v) for i, v in enumerate(bad)],
        "id bigint, text string, reply string, vector array<double>",
    )
    msgs = spark.createDataFrame(
        [(1, "login fails", "account_access", 0.9, [1.0, 0.5])] + [(20 + i, "login fails", "account_access", 0.9, v) for i, v in enumerate(bad)],
        "id bigint, text string, intent string, intent_confidence double, vector array<double>",
    )
    index = similarity.build_cells(docs.filter("id < 10 OR size(vector) = 2"), 2)
    for kwargs in ({}, {"index": index, "probe": 2}):
        got = {r["id"]: r for r in triage.triage(msgs, docs, 2, **kwargs).collect()}
        assert got[1]["reply"] == "reply 4"
        assert all(got[20 + i]["decision_source"] == "insufficient_evidence" for i in range(len(bad)))


def test_saved_terms_keep_their_stop_words(spark, talk, tmp_path):
    model = features.fit_terms(talk, "conversation_id", "customer_message", SETTINGS, stop_words=["problem", "my"])
    model.save(spark, str(tmp_path / "t"))
    again = features.TermModel.load(spark, str(tmp_path / "t"))
    assert again.stop_words == ["problem", "my"]
    rows = [m.transform(talk, "conversation_id", "customer_message").orderBy("conversation_id").collect() for m in (model, again)]
    assert rows[0] == rows[1] and any(len(r["indices"]) for r in rows[0])


def test_lazy_scoring_equals_the_model(spark, talk):
    classifier, _ = intents.train_text_classifier(talk, "conversation_id", "customer_message", "intent", SETTINGS)
    odd = talk.select("conversation_id", "customer_message").union(spark.createDataFrame([(900, ""), (901, None), (902, "unknown words alone")], talk.select("conversation_id", "customer_message").schema))
    lazy = {r["conversation_id"]: r for r in classifier.predict(odd, "conversation_id", "customer_message").collect()}
    vectors = classifier.terms.transform_to_vectors(odd, "conversation_id", "customer_message")
    for r in classifier.predict_features(vectors, ["conversation_id"]).collect():
        got = lazy.pop(r["conversation_id"])
        assert got["intent"] == r["intent"] and all(got["probabilities"][c] == pytest.approx(p, abs=1e-9) for c, p in r["probabilities"].items())
    assert not lazy
    text = classifier.predict(odd, "conversation_id", "customer_message")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text


def test_missing_outcomes_count_as_wrong(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id bigint, true_intent string")
    done = spark.createDataFrame([(1, "a", True, 0.5)], "id bigint, intent string, should_escalate boolean, escalation_score double")
    row = metrics.classification(triage.evaluate_golden(done, gold)).first()
    assert row["accuracy"] == pytest.approx(1 / 3)
    assert {r["label"] for r in metrics.per_class(triage.evaluate_golden(done, gold)).collect()} == {"a", "b"}


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    """A file of one row group read in many splits: all rows would be one task's."""
    spark.range(4000).selectExpr("id", "repeat(cast(id as string), 20) AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = spark.read.parquet(str(tmp_path / "t"))
        cores = spark.sparkContext.defaultParallelism
        assert rows.rdd.getNumPartitions() >= cores
        even = features.spread(rows)
        sizes = [r["n"] for r in even.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / cores
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_projection_holds_few_rows_at_once(spark):
    """Long rows of one batch are taken a block at a time."""
    import pyarrow as pa

    size = intents.BLOCK_CELLS // 8
    batch = pa.RecordBatch.from_pylist([{"indices": [i, 7 + i], "values": [1.0, 2.0]} if i % 3 else {"indices": [], "values": []} for i in range(50)])
    seen = [x.copy() for x in intents._dense_blocks(batch.slice(5), size)]
    assert max(x.size for x in seen) <= intents.BLOCK_CELLS
    whole = np.concatenate(seen)
    assert len(whole) == 45 and whole[1, 6] == 0 and whole[2, 7] == 1 and whole[2, 14] == 2


@pytest.mark.parametrize("files", [0, 3])
def test_streamed_table_is_a_file_or_a_folder(spark, tmp_path, data_dir, files):
    """The driver's larger tables are folders."""
    import shutil

    from threadloom import catalog

    table = f"{data_dir}/conversations.parquet"
    if files:
        spark.read.parquet(table).repartition(files).write.parquet(str(tmp_path / "conversations.parquet"))
    else:
        shutil.copy(table, tmp_path / "conversations.parquet")
    got = catalog.QUERIES["t1_stream_scoring"](spark, str(tmp_path))
    assert got.count() == catalog.QUERIES["d4_escalation_without_generator"](spark, str(tmp_path)).count() > 0


def test_training_cuts_a_text_once_for_each_of_its_three_uses(spark, talk, tmp_path, monkeypatch):
    """Discovery with its labels, classifier, baseline; fits and transforms share the words."""
    cuts, cut = [], features.words
    for module in (features, intents):
        if hasattr(module, "words"):
            monkeypatch.setattr(module, "words", lambda *a: cuts.append(1) or cut(*a))
    blank = spark.createDataFrame([(900, None), (901, ""), (902, "short")], "conversation_id bigint, customer_message string")
    out = training.train(
        talk.drop("intent").union(blank), str(tmp_path / "out"), target=20, k=4, discovery=SETTINGS, classification=SETTINGS,
        baseline=TermSettings(2, 0.9, 300), max_iter=10,
    )
    assert out.labelled.count() == 243 and out.labelled.filter("intent is null").count() == 0
    assert len(cuts) == 3


def test_pairs_that_cannot_be_kept_are_not_counted_by_name(spark, talk, monkeypatch):
    """The vocabulary is that of all counts, with several blocks of words to a batch."""
    monkeypatch.setattr(features, "BLOCK_WORDS", 50)
    rows = features.cut(talk.repartition(3), "conversation_id", "customer_message")
    every = features.term_frequencies(rows, "customer_message")
    for settings in (TermSettings(2, 0.9, 8), TermSettings(1, 1.0, 15), TermSettings(3, 0.5, 2000)):
        some = features.kept_frequencies(rows, 240, settings)
        want, got = ([tuple(r) for r in features.vocabulary(x, 240, settings).collect()] for x in (every, some))
        assert got == want and len(got) > 5
        assert settings.max_features > 100 or some.count() < every.count() - 50


def test_rows_of_one_id_are_one_document(spark, monkeypatch):
    """Their terms are counted together, wherever the rows are."""
    texts = [(1, "ab cd ab"), (2, "cd"), (None, "ab"), (1, "cd cd xx"), (3, ""), (None, None), (2, "cd")] * 3
    df = spark.createDataFrame(texts, "id bigint, text string").repartition(4)
    model = features.fit_terms(df, "id", "text", TermSettings(1, 1.0, 100))
    terms = list(model.table["term"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = {r["id"]: dict(zip((terms[i] for i in r["indices"]), r["values"])) for r in model.transform(df, "id", "text").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {1, 2, 3, None} and got[3] == {} and got[2] == {"cd": 1.0} and got[None] == {"ab": 1.0}
    idf = {t: np.log(22 / (1 + d)) + 1 for t, d in zip(terms, model.table["df"])}
    want = {t: n * idf[t] for t, n in {"ab": 6, "cd": 9, "xx": 3, "ab cd": 3, "cd ab": 3, "cd cd": 3, "cd xx": 3}.items()}
    length = np.sqrt(sum(x * x for x in want.values()))
    assert got[1] == {t: pytest.approx(x / length) for t, x in want.items()}


@pytest.mark.parametrize("name", ["m7_assign_intents", "s9_saved_discovery"])
def test_discovery_and_its_labels_cut_texts_once(spark, data_dir, monkeypatch, name):
    from threadloom import catalog

    cuts, cut = [], features.words
    for module in (features, intents):
        monkeypatch.setattr(module, "words", lambda *a: cuts.append(1) or cut(*a))
    catalog.QUERIES[name](spark, data_dir)
    assert len(cuts) == 1
