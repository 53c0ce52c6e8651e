"""Queries on clustering, classification, the long jobs, files and streams."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..config import CLASSIFIER_TERMS, DISCOVERY_TERMS
from ..operators import features, intents, metrics, similarity
from ..plans import preparation, training
from ..session import scratch_path
from ..sources import standins as st, tables, tweets as raw
from ..streaming import scoring
from . import sql as s
from .judgements import _decision_columns, _decision_sql, _TRIAGE
from .registry import query
from .similarity import _DISCOVERY, _docs, CELLS, DIM
from .texts import _naming_sql

# ------------------------------------------------- clusters given as languages

_CLUSTERS = """
members AS (SELECT doc_id AS id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS cluster_id FROM documents),
sizes AS (SELECT cluster_id, count(*) AS size FROM members GROUP BY cluster_id),
means AS (SELECT m.cluster_id, w.term, round(sum(w.w) / any_value(z.size), 12) AS mean_weight FROM g_weights w JOIN members m ON m.id = w.id
  JOIN sizes z ON z.cluster_id = m.cluster_id GROUP BY m.cluster_id, w.term),
topterms AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY mean_weight DESC, term) AS rn FROM means)"""


def _members(spark, sf_dir):
    lang = F.col("lang")
    return st.documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        F.when(lang == "de", 0).when(lang == "en", 1).when(lang == "es", 2).otherwise(3).alias("cluster_id"),
    )


def _weights(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    model = features.fit_terms(docs, "id", "text", DISCOVERY_TERMS)
    return intents.term_weights(model.transform(docs, "id", "text"), model, "id")


@query("w5_top_cluster_terms", s.with_(_DISCOVERY, _CLUSTERS, body=f"""
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, term, {s.r6('mean_weight')} AS mean_weight, rn FROM topterms WHERE rn <= 15"""))
def w5(spark, sf_dir):
    return intents.top_cluster_terms(_members(spark, sf_dir), _weights(spark, sf_dir), "id")


@query("w6_cluster_examples", s.with_(_CLUSTERS.split(",\nsizes")[0], body="""
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, rn, id, text FROM (SELECT m.*, d.text, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS rn
  FROM members m JOIN documents d ON d.doc_id = m.id) WHERE rn <= 5"""))
def w6(spark, sf_dir):
    return intents.examples(_members(spark, sf_dir), _docs(spark, sf_dir), "id", "text")


@query("a11_cluster_profile", s.with_(_DISCOVERY, _CLUSTERS, _naming_sql(
    "SELECT cluster_id AS id, string_agg(term, ' ' ORDER BY rn) AS joined FROM topterms WHERE rn <= 10 GROUP BY cluster_id"), body=f"""
SELECT CAST(z.cluster_id AS BIGINT) AS cluster_id, z.size, {s.pct2('z.size', '(SELECT sum(size) FROM sizes)')} AS pct, n.name,
  (SELECT string_agg(term, ',' ORDER BY rn) FROM topterms t WHERE t.cluster_id = z.cluster_id AND rn <= 10) AS terms
FROM sizes z JOIN named n ON n.id = z.cluster_id"""))
def a11(spark, sf_dir):
    found = intents.taxonomy(_members(spark, sf_dir), _weights(spark, sf_dir), _docs(spark, sf_dir), "id", "text")
    return found.select("cluster_id", "size", "pct", "name", F.array_join("terms", ",").alias("terms"))


_NAMED = """
named_members AS (SELECT id, CASE cluster_id WHEN 0 THEN 'billing_payment' WHEN 1 THEN 'playback_issues' WHEN 3 THEN 'billing_payment'
  ELSE 'general_inquiry' END AS intent FROM members)"""


def _named(spark, sf_dir):
    """Two clusters of one name and one cluster without a name."""
    names = spark.createDataFrame([(0, "billing_payment"), (1, "playback_issues"), (3, "billing_payment")], "cluster_id int, name string")
    return intents.name_members(_members(spark, sf_dir), names)


@query("j14_cluster_names", s.with_(_CLUSTERS.split(",\nsizes")[0], _NAMED, body="SELECT id, intent FROM named_members"))
def j14(spark, sf_dir):
    return _named(spark, sf_dir).select("id", "intent")


@query("a10_intent_distribution", s.with_(_CLUSTERS.split(",\nsizes")[0], _NAMED, body=f"""
SELECT intent, {s.count()} AS n, {s.pct2('count(*)', '(SELECT count(*) FROM named_members)')} AS pct FROM named_members GROUP BY intent"""))
def a10(spark, sf_dir):
    return intents.intent_distribution(_named(spark, sf_dir))


@query("w11_best_class", f"""
WITH p AS (SELECT vec_id, unnest(range(0, 4)) AS c, unnest([abs(e[1]), abs(e[2]), abs(e[3]), abs(e[4])]) AS v
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, c) AS rn FROM p)
SELECT vec_id, 'c' || CAST(c AS VARCHAR) AS intent, {s.r6('v')} AS confidence FROM b WHERE rn = 1""")
def w11(spark, sf_dir):
    cell = [F.abs(F.col("embedding")[i].cast("double")) for i in range(4)]
    scored = F.array(*[F.struct(c.alias("p"), F.lit(-i).alias("order"), F.lit(f"c{i}").alias("c")) for i, c in enumerate(cell)])
    return st.table(spark, sf_dir, "embeddings").withColumn("b", intents.best_class(scored)).select(
        "vec_id", F.col("b.c").alias("intent"), F.col("b.p").alias("confidence")
    )


@query("m8_label_encoding", """
SELECT lang AS label, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM documents)""")
def m8(spark, sf_dir):
    return intents.encode_labels(st.documents(spark, sf_dir), "lang")


@query("m9_class_weights", f"""
SELECT lang, {s.r6('(SELECT count(*) FROM documents)::DOUBLE / ((SELECT count(DISTINCT lang) FROM documents) * count(*))')} AS weight FROM documents GROUP BY lang""")
def m9_weights(spark, sf_dir):
    return intents.class_weights(st.documents(spark, sf_dir), "lang")


# --------------------------------------------------------------------- models

@query("m4_projection")
def m4(spark, sf_dir):
    """Share of the squared weight the projection keeps, per document."""
    docs = _docs(spark, sf_dir)
    model = features.fit_terms(docs, "id", "text", DISCOVERY_TERMS)
    rows = model.stage_rows(docs, "id", "text")
    dense = intents.project(rows.sparse(), "id", intents.fit_projection(rows.sparse(), model.size, 100))
    cells = vector_to_array("features")
    return dense.select("id", F.aggregate(cells, F.lit(0.0), lambda a, x: a + x * x).alias("kept"), F.size(cells).alias("dims"))


def _discovered(spark, sf_dir):
    return intents.discover(_docs(spark, sf_dir), "id", "text", k=10, settings=DISCOVERY_TERMS)


def _discovered_once(spark, sf_dir):
    """The model and the cleaned rows it was made of, for a job that also labels them."""
    rows = intents.cleaned(_docs(spark, sf_dir), "id", "text")
    return intents.discover(rows, "id", "text", k=10, settings=DISCOVERY_TERMS)[0], rows


@query("m5_clusters")
def m5(spark, sf_dir):
    model, _ = _discovered(spark, sf_dir)
    return intents.cluster_sizes(model.cluster(_docs(spark, sf_dir), "id", "text"))


@query("m5_cluster_totals", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(10 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS not_nearest FROM documents")
def m5_totals(spark, sf_dir):
    """Documents placed, clusters in use, and documents for which another centre is nearer than their own."""
    model, _ = _discovered(spark, sf_dir)
    return model.placement(_docs(spark, sf_dir), "id", "text")


@query("m6_discover_taxonomy")
def m6(spark, sf_dir):
    _, found = _discovered(spark, sf_dir)
    return found.select("cluster_id", "name", "size", "pct", F.array_join("terms", ",").alias("terms"), F.size("examples").alias("n_examples"))


@query("m7_assign_intents")
def m7(spark, sf_dir):
    model, rows = _discovered_once(spark, sf_dir)
    return model.assign(rows, "id", "text")


@query("s9_saved_discovery", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS changed FROM documents")
def s9_discovery(spark, sf_dir):
    """A discovery model read back labels every message as before."""
    model, rows = _discovered_once(spark, sf_dir)
    path = scratch_path(spark, "intents")
    model.save(spark, path)
    again = intents.IntentModel.load(spark, path).assign(rows, "id", "text").select("id", F.col("intent").alias("again"))
    both = model.assign(rows, "id", "text").join(again, "id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("intent") != F.col("again")).alias("changed"))


@query("m9_text_classifier")
def m9(spark, sf_dir):
    _, held = intents.train_text_classifier(st.documents(spark, sf_dir), "doc_id", "text", "lang", CLASSIFIER_TERMS)
    return metrics.classification(held)


@query("m9_vector_classifier")
def m9_vectors(spark, sf_dir):
    emb = st.table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string"))
    _, held = intents.train_vector_classifier(emb, "vec_id", "embedding", "label")
    return metrics.classification(held)


def m11_predicted(spark, sf_dir):
    docs = st.documents(spark, sf_dir)
    classifier, _ = intents.train_text_classifier(docs, "doc_id", "text", "lang", CLASSIFIER_TERMS)
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "my account login").otherwise("").alias("context"))
    return classifier.predict(rows, "doc_id", "text", "context")


@query("m11_predict_intents")
def m11(spark, sf_dir):
    out = m11_predicted(spark, sf_dir)
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", "intent", "confidence", F.round(total, 6).alias("probability_total"))


@query("m11_sound_probabilities", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS bad_totals, CAST(0 AS BIGINT) AS not_the_maximum, CAST(0 AS BIGINT) AS unknown_labels FROM documents")
def m11_sound(spark, sf_dir):
    """Of all predictions: probabilities that do not sum to one, intents that are not the most probable label, and labels never trained on."""
    out = m11_predicted(spark, sf_dir)
    labels = [r["lang"] for r in st.documents(spark, sf_dir).select("lang").distinct().collect()]  # one row per class
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x)
    most = F.array_max(F.map_values("probabilities"))
    return out.agg(
        F.count("*").alias("n"), F.count_if(F.abs(total - 1) > 1e-9).alias("bad_totals"),
        F.count_if((F.element_at("probabilities", F.col("intent")) < most) | (F.col("confidence") < most)).alias("not_the_maximum"),
        F.count_if(~F.col("intent").isin(labels)).alias("unknown_labels"))


@query("d8_training_job")
def d8(spark, sf_dir):
    emb = st.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = training.run(
        st.strata(spark, sf_dir).select("conversation_id", "customer_message"), scratch_path(spark, "training"), emb)
    return out.metrics.withColumn("model", F.lit("terms")).unionByName(out.vector_metrics.withColumn("model", F.lit("vectors")))


# ------------------------------------------------------------ files and tables


@query("s1_read_csv", s.with_(s.TWEETS, body="SELECT * FROM tweets"))
def s1(spark, sf_dir):
    """Tweets through CSV and back, quoted newlines included."""
    path = scratch_path(spark, "tweets-csv")
    tables.write_csv(st.tweets(spark, sf_dir), path)
    return raw.read_tweets(spark, path)


@query("s2_write_parquet", s.with_(*s.ALL_CONVERSATIONS, body="SELECT conversation_id, brand, customer_message, conversation_length FROM prepared"))
def s2(spark, sf_dir):
    path = scratch_path(spark, "conversations")
    tables.write_parquet(preparation.prepare(st.tweets(spark, sf_dir)), path)
    return spark.read.parquet(path).select("conversation_id", "brand", "customer_message", "conversation_length")


@query("s3_write_csv", s.with_(*s.ALL_CONVERSATIONS, body="SELECT conversation_id, customer_message, historical_support_response FROM prepared"))
def s3(spark, sf_dir):
    path = scratch_path(spark, "conversations-csv")
    rows = preparation.prepare(st.tweets(spark, sf_dir)).select("conversation_id", "customer_message", "historical_support_response")
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.schema)


@query("s4_table_format", s.with_(s.TWEETS, body=f"SELECT author_id, {s.count()} AS n FROM tweets GROUP BY author_id"))
def s4(spark, sf_dir):
    """Delta when it is installed, Parquet otherwise."""
    path = scratch_path(spark, "table")
    fmt = "delta" if tables.write_table_format(st.tweets(spark, sf_dir), path, "delta") else "parquet"
    if fmt == "parquet":
        tables.write_table_format(st.tweets(spark, sf_dir), path, fmt)
    return spark.read.format(fmt).load(path).groupBy("author_id").agg(F.count("*").alias("n"))


@query("s5_write_report", s.with_(s.TWEETS, body=f"SELECT inbound, {s.count()} AS n FROM tweets GROUP BY inbound"))
def s5(spark, sf_dir):
    path = scratch_path(spark, "report")
    rows = st.tweets(spark, sf_dir).groupBy("inbound").agg(F.count("*").alias("n"))
    tables.write_report(rows, path)
    return tables.read_report(spark, path, rows.schema)


@query("s8_blanks_to_null", s.with_(s.TWEETS, body="""
SELECT tweet_id, CASE WHEN tweet_id % 3 = 0 OR response_tweet_id IS NULL THEN NULL ELSE response_tweet_id END AS reply,
  CASE WHEN tweet_id % 5 <> 0 THEN 1.5::DOUBLE END AS score FROM tweets"""))
def s8(spark, sf_dir):
    tid = F.col("tweet_id")
    rows = st.tweets(spark, sf_dir).select(
        "tweet_id", F.when(tid % 3 == 0, "").otherwise(F.coalesce("response_tweet_id", F.lit("nan"))).alias("reply"),
        F.when(tid % 5 == 0, float("nan")).otherwise(1.5).alias("score"),
    )
    return tables.blanks_to_null(rows)


@query("s9_saved_terms", s.with_(_DISCOVERY, body="SELECT term, df, cf FROM g_vocab"))
def s9(spark, sf_dir):
    path = scratch_path(spark, "terms")
    features.fit_terms(_docs(spark, sf_dir), "id", "text", DISCOVERY_TERMS).save(spark, path)
    return features.TermModel.load(spark, path).as_frame(spark).select("term", "df", "cf")


# --------------------------------------------------------------------- streams


@query("t1_stream_triage", s.with_(*_TRIAGE, body=f"""
SELECT id, intent, reply, {s.r6('best_score')} AS best_score, n_cases, decision_source, {s.DECISION_SCORE} AS escalation_score FROM decided"""))
def t1_triage(spark, sf_dir):
    """Triage of arriving messages against a static history through a cell index; equals the batch job."""
    history = st.vectors(spark, sf_dir)
    source, sink = scratch_path(spark, "arriving"), scratch_path(spark, "triaged")
    history.withColumn("intent_confidence", (F.col("id") % 100) / 100.0).repartition(2).write.parquet(source)
    arriving = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    index = similarity.build_cells(history, CELLS)
    job = scoring.triage_job(history, DIM, index=index, probe=CELLS, skip_same=True)
    scoring.start(arriving, sink, scratch_path(spark, "stream-state"), job).awaitTermination()
    return spark.read.parquet(sink).select("id", "intent", "reply", "best_score", "n_cases", "decision_source", "escalation_score")


@query("t1_stream_scoring", s.with_(s.TWEETS, s.REQUESTS, s.decided("requests", generator="false"), body=_decision_sql()))
def t1(spark, sf_dir):
    """Escalation of arriving messages, joined with known best scores; equals the batch job."""
    conv = st.table(spark, sf_dir, "conversations")
    known = st.requests(st.tweets(spark, sf_dir)).select("tweet_id", "best_score")
    # A pattern, for a table that is one file or a folder of files: a plain path has to be a folder.
    arriving = spark.readStream.schema(conv.schema).parquet(f"{sf_dir}/conversations.parque[t]")
    messages = st.tweet_columns(arriving).filter("inbound").select(
        "tweet_id", "text", ((F.col("tweet_id") % 100) / 100.0).alias("intent_confidence")
    )
    sink = scratch_path(spark, "scored")
    job = scoring.start(scoring.with_history(messages, known, "tweet_id"), sink, scratch_path(spark, "stream-state"))
    job.awaitTermination()
    return _decision_columns(spark.read.parquet(sink))
