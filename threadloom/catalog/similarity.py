"""Queries on term features, vectors and retrieval."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..config import BASELINE_TERMS, DISCOVERY_TERMS
from ..functions import rules, vectors as vec
from ..operators import baselines, features, retrieval, similarity
from ..session import scratch_path
from ..sources import standins as st
from . import sql as s
from .registry import query

DIM = 64


def _docs(spark, sf_dir):
    return st.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.col("source").alias("reply"))


def _asks(spark, sf_dir):
    return st.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


_WORDS = rf"list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({s.STOP}))"


@query("m1_terms", f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(greatest(len(w) - 1, 0) AS BIGINT) AS n_pairs, md5(array_to_string(w, ' ')) AS words_md5,
  w[1] || ' ' || w[2] AS first_pair FROM (SELECT doc_id, {_WORDS} AS w FROM documents)""")
def m1(spark, sf_dir):
    t = st.documents(spark, sf_dir).select("doc_id", features.words(F.col("text")).alias("w")).withColumn("t", features.terms(F.col("w")))
    n = F.size("w")
    return t.select(
        "doc_id", n.alias("n_words"), (F.size("t") - n).alias("n_pairs"), F.md5(F.array_join("w", " ")).alias("words_md5"),
        F.try_element_at("t", n + 1).alias("first_pair"),
    )


_FIT = s.tfidf("b", "documents", "doc_id", "text", 2, 0.9, 10_000, False)
_DISCOVERY = s.tfidf("g", "documents", "doc_id", "text", 5, 0.8, 5_000, True)


@query("m2_vocabulary", s.with_(_FIT, body="SELECT term, df, cf FROM b_vocab"))
def m2(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return features.vocabulary(features.term_frequencies(docs, "text"), docs.count(), BASELINE_TERMS)


@query("m2_discovery_vocabulary", s.with_(_DISCOVERY, body="SELECT term, df, cf FROM g_vocab"))
def m2_discovery(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return features.vocabulary(features.term_frequencies(docs, "text"), docs.count(), DISCOVERY_TERMS)


def _long(rows, model):
    from ..operators.intents import term_weights

    return term_weights(rows, model, "id")


@query("m3_tfidf_weights", s.with_(_FIT, body=f"SELECT id, term, {s.r6('w')} AS weight FROM b_weights"))
def m3(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    model = features.fit_terms(docs, "id", "text", BASELINE_TERMS)
    return _long(model.transform(docs, "id", "text"), model)


@query("m3_sublinear_weights", s.with_(_DISCOVERY, body=f"SELECT id, term, {s.r6('w')} AS weight FROM g_weights"))
def m3_sublinear(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    model = features.fit_terms(docs, "id", "text", DISCOVERY_TERMS)
    return _long(model.transform(docs, "id", "text"), model)


_ASKED = s.tfidf("b", "documents", "doc_id", "text", 2, 0.9, 10_000, False, apply_to=("benchmark", "item_id", "text"))
_SIMILAR = """
cosine AS (
  SELECT a.id AS q_id, d.id AS d_id, round(sum(a.w * d.w), 9) AS score FROM bo_weights a JOIN b_weights d USING (term) GROUP BY a.id, d.id
),
nearest AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, d_id) AS "rank" FROM cosine WHERE score >= 1e-9)
"""


@query("j17_similar_by_terms", s.with_(_ASKED, _SIMILAR, body=f"""
SELECT q_id, d_id, {s.r6('score')} AS score, "rank" FROM nearest WHERE "rank" <= 5"""))
def j17(spark, sf_dir):
    return baselines.similar_history(_asks(spark, sf_dir), _docs(spark, sf_dir), 5)


@query("m10_nearest_reply", s.with_(_ASKED, _SIMILAR, body=f"""
SELECT b.item_id AS id, n.d_id AS similar_id, coalesce(d.source, '') AS reply, {s.r6('coalesce(n.score, 0)')} AS confidence,
  coalesce(n.score, 0) < 0.1::DOUBLE AS should_escalate, CASE WHEN coalesce(n.score, 0) < 0.1::DOUBLE THEN 'Low similarity match' END AS escalation_reason,
  d.text AS similar_message
FROM benchmark b LEFT JOIN nearest n ON n.q_id = b.item_id AND n."rank" = 1 LEFT JOIN documents d ON d.doc_id = n.d_id"""))
def m10(spark, sf_dir):
    return baselines.nearest_reply(_asks(spark, sf_dir), _docs(spark, sf_dir))


# ------------------------------------------------------------------- vectors


@query("m12_normalise", s.with_("""
n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS len FROM embeddings)""",
    body=f"SELECT vec_id AS id, {s.r6('len')} AS length, {s.r6('v[1] / len')} AS first_cell, {s.r6('v[64] / len')} AS last_cell FROM n"))
def m12(spark, sf_dir):
    v = st.table(spark, sf_dir, "embeddings").withColumn("unit", vec.normalise(F.col("embedding")))
    return v.select(
        F.col("vec_id").alias("id"), vec.norm(F.col("embedding")).alias("length"), F.col("unit")[0].alias("first_cell"),
        F.col("unit")[DIM - 1].alias("last_cell"),
    )


@query("m12_embed", s.with_("""
c AS (SELECT doc_id AS id, [length(t)::DOUBLE, (length(t) - length(replace(t, ' ', '')))::DOUBLE, (length(t) - length(replace(t, 'e', '')))::DOUBLE] AS v
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
n AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS len FROM c)""",
    body=f"SELECT id, {s.r6('CASE WHEN len > 0 THEN v[1] / len ELSE 0 END')} AS a, {s.r6('CASE WHEN len > 0 THEN v[2] / len ELSE 0 END')} AS b, {s.r6('CASE WHEN len > 0 THEN v[3] / len ELSE 0 END')} AS c FROM n"))
def m12_embed(spark, sf_dir):
    """An encoder plugged in: counts of characters, blanks and the letter e."""
    @F.pandas_udf("array<float>")
    def counts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), float(t.count(" ")), float(t.count("e"))])

    v = retrieval.embed(_docs(spark, sf_dir), "text", counts)
    return v.select("id", *[F.col("vector")[i].alias(n) for i, n in enumerate("abc")])


@query("m15_retrieval_table", """
SELECT d.doc_id AS conversation_id, coalesce(d.text, '') AS customer_message, coalesce(d.source, '') AS historical_support_response,
  '' AS conversation_context, coalesce(d.lang, '') AS brand, CAST(len(e.embedding) AS BIGINT) AS dim
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def m15(spark, sf_dir):
    conv = st.documents(spark, sf_dir).select(
        F.col("doc_id").alias("conversation_id"), F.col("text").alias("customer_message"),
        F.col("source").alias("historical_support_response"), F.col("lang").alias("brand"),
    )
    v = st.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conversation_id"), F.col("embedding").alias("vector"))
    return retrieval.build_documents(conv, v).withColumn("dim", F.size("vector")).drop("vector")


def _pool(spark, sf_dir, k=15):
    v = st.vectors(spark, sf_dir)
    return similarity.exact_top_k(v, v, k, DIM, skip_same=True)


def _rank_sql(k: int) -> str:
    return s.with_(s.VECTORS, body=f'SELECT q_id, d_id, {s.r6("score")} AS score, "rank" FROM ranked WHERE "rank" <= {k}')


@query("j11_candidate_pool", _rank_sql(15))
def j11(spark, sf_dir):
    return _pool(spark, sf_dir)


@query("w3_pool_of_ten", _rank_sql(30))
def w3(spark, sf_dir):
    return _pool(spark, sf_dir, max(3 * 10, 15))


@query("m13_exact_top_five", _rank_sql(5))
def m13(spark, sf_dir):
    return _pool(spark, sf_dir, 5)


@query("j11_blocked_grid", _rank_sql(15))
def j11_grid(spark, sf_dir):
    """The path for query sets too large to broadcast: both sides meet in a grid."""
    v = st.vectors(spark, sf_dir)
    return similarity.exact_top_k(v, v, 15, DIM, skip_same=True, broadcast_bytes=100_000)


CELLS, PROBE = 24, 16


@query("m14_cell_search")
def m14(spark, sf_dir):
    v = st.vectors(spark, sf_dir)
    path = scratch_path(spark, "cells")
    similarity.build_cells(v, CELLS).save(path)
    return similarity.CellIndex.load(spark, path).search(v, 5, PROBE, skip_same=True)


@query("m14_all_cells", _rank_sql(5))
def m14_all(spark, sf_dir):
    """With every cell probed the index gives the exact result."""
    v = st.vectors(spark, sf_dir)
    return similarity.build_cells(v, CELLS).search(v, 5, CELLS, skip_same=True)


@query("m14_cell_recall", "SELECT CAST(sum(least(5, n - 1)) AS BIGINT) AS n, TRUE AS enough FROM (SELECT count(*) OVER () AS n FROM embeddings)")
def m14_recall(spark, sf_dir):
    """Whether the cell search finds nine tenths of the exact top five."""
    exact = m13(spark, sf_dir).select("q_id", "d_id")
    found = m14(spark, sf_dir).select("q_id", "d_id").withColumn("found", F.lit(1))
    return exact.join(found, ["q_id", "d_id"], "left").agg(F.count("*").alias("n"), (F.avg(F.coalesce("found", F.lit(0))) >= 0.9).alias("enough"))


@query("m14_cells_by_join", _rank_sql(5))
def m14_by_join(spark, sf_dir):
    """Queries sent to all cells by a join, with parts of cells and of queries as small as can be: the exact result."""
    v = st.vectors(spark, sf_dir)
    return similarity.build_cells(v, CELLS).search(v, 5, CELLS, skip_same=True, broadcast_bytes=20_000)


def _hits(spark, sf_dir, pool=None):
    v = st.vectors(spark, sf_dir)
    return retrieval.rerank(_pool(spark, sf_dir) if pool is None else pool, v, v)


@query("w4_reranked_hits", s.with_(s.VECTORS, s.reranked(), body=f"""
SELECT q_id, d_id, {s.r6('base_score')} AS base_score, {s.r6('score')} AS score, "rank" FROM hits"""))
def w4(spark, sf_dir):
    return _hits(spark, sf_dir)


@query("j12_evidence_gate", s.with_(s.VECTORS, body=f"""
SELECT id AS q_id, CAST(count(q_id) AS BIGINT) AS kept, count(q_id) = 0 AS gated FROM vectors LEFT JOIN
  (SELECT * FROM ranked WHERE "rank" <= 15 AND score >= 0.4::DOUBLE) h ON h.q_id = id GROUP BY id"""))
def j12(spark, sf_dir):
    pool, v = _pool(spark, sf_dir), st.vectors(spark, sf_dir)
    kept = retrieval.evidence(pool, 0.4).groupBy("q_id").agg(F.count("*").alias("kept")).withColumn("gated", F.lit(False))
    none = retrieval.without_evidence(v, pool, 0.4).select("q_id", F.lit(0).cast("bigint").alias("kept"), F.lit(True).alias("gated"))
    return kept.unionByName(none)


def _flagged(spark, sf_dir, pool=None):
    """Pool with hits of the query's own label marked; relevant documents are counted per label, never listed."""
    v = st.vectors(spark, sf_dir)
    q = v.select(F.col("id").alias("q_id"), F.col("label").alias("q_label"))
    d = v.select(F.col("id").alias("d_id"), F.col("label").alias("d_label"))
    flagged = (_pool(spark, sf_dir) if pool is None else pool).join(q, "q_id").join(d, "d_id").withColumn("is_relevant", F.col("q_label") == F.col("d_label"))
    n = q.join(v.groupBy(F.col("label").alias("q_label")).agg((F.count("*") - 1).alias("n")), "q_label").select("q_id", "n")
    return flagged.select("q_id", "d_id", "rank", "is_relevant"), n


_RELEVANT = """
relevant AS (SELECT a.id AS q_id, b.id AS d_id FROM vectors a JOIN vectors b ON a.label = b.label AND a.id <> b.id),
n_rel AS (SELECT v.id AS q_id, count(r.d_id) AS n FROM vectors v LEFT JOIN relevant r ON r.q_id = v.id GROUP BY v.id),
marked AS (SELECT k.*, r.d_id IS NOT NULL AS rel FROM ranked k LEFT JOIN relevant r ON r.q_id = k.q_id AND r.d_id = k.d_id WHERE k."rank" <= 15),
per_q AS (SELECT n.q_id, n.n, min(CASE WHEN rel THEN "rank" END) AS first_hit, """ + ", ".join(
    f'count_if(rel AND "rank" <= {k}) AS hit{k}, count_if("rank" <= {k}) AS got{k}' for k in (1, 3, 5)
) + " FROM n_rel n LEFT JOIN marked m ON m.q_id = n.q_id GROUP BY n.q_id, n.n)"
_METRICS = ", ".join(
    f"{s.r6(f'avg(CASE WHEN n > 0 THEN hit{k}::DOUBLE / n END)')} AS recall_at_{k}, {s.r6(f'avg(hit{k}::DOUBLE / greatest(got{k}, 1))')} AS precision_at_{k}"
    for k in (1, 3, 5)
)


@query("a21_retrieval_metrics", s.with_(s.VECTORS, _RELEVANT, body=f"SELECT {_METRICS}, {s.r6('avg(coalesce(1.0::DOUBLE / first_hit, 0))')} AS mrr FROM per_q"))
def a21(spark, sf_dir):
    return retrieval.retrieval_metrics(*_flagged(spark, sf_dir))


@query("a22_mean_reciprocal_rank", s.with_(s.VECTORS, _RELEVANT, body=f"SELECT {s.r6('avg(coalesce(1.0::DOUBLE / first_hit, 0))')} AS mrr FROM per_q"))
def a22(spark, sf_dir):
    return retrieval.retrieval_metrics(*_flagged(spark, sf_dir), ks=()).select("mrr")


@query("a29_mean_top_score", s.with_(s.VECTORS, s.reranked(), body=f"""
SELECT {s.r6('avg(score)')} AS mean_top1, {s.count()} AS n_queries FROM hits WHERE "rank" = 1"""))
def a29(spark, sf_dir):
    return retrieval.mean_top_score(_hits(spark, sf_dir))


_PROMPT = """
evidence AS (
  SELECT h.q_id, string_agg('--- Evidence ' || CAST(h."rank" AS VARCHAR) || ' ---' || chr(10) || CAST(to_json({
      'evidence_id': h."rank", 'similarity': round(h.score, 3), 'historical_customer_message': d.text, 'historical_support_response': d.reply
    }) AS VARCHAR), chr(10) ORDER BY h."rank") AS blocks
  FROM hits h JOIN vectors d ON d.id = h.d_id GROUP BY h.q_id
)"""


@query("p24_prompts", s.with_(s.VECTORS, s.reranked(), _PROMPT, body=f"SELECT *, {s.q(rules.SYSTEM_PROMPT)} AS system FROM (" + r"""
SELECT v.id, 'CURRENT CUSTOMER MESSAGE:' || chr(10) || v.text || chr(10) || chr(10) || '[Predicted Intent: ' || v.intent || ' (Confidence: '
  || format('{:.2f}', (v.id % 100) / 100.0::DOUBLE) || ')]' || chr(10) || chr(10) || 'CURRENT CONVERSATION CONTEXT:' || chr(10) || v.reply || chr(10)
  || '(Context helps to understand the message; it is no permission to invent facts)'
  || chr(10) || chr(10) || 'HISTORICAL EVIDENCE:' || chr(10) || coalesce(e.blocks, 'None found. (Escalate: there is no evidence)')
  || chr(10) || chr(10) || 'INSTRUCTIONS:' || chr(10) || 'Draft a reply from the HISTORICAL EVIDENCE only. Answer with one JSON object with the fields reply, '
  || 'grounded_claims, evidence_ids, needs_escalation and grounding_confidence (0.0 to 1.0).' || chr(10) || 'Return ONLY valid JSON.' AS prompt
FROM vectors v LEFT JOIN evidence e ON e.q_id = v.id WHERE v.reply <> ''
UNION ALL
SELECT v.id, 'CURRENT CUSTOMER MESSAGE:' || chr(10) || v.text || chr(10) || chr(10) || '[Predicted Intent: ' || v.intent || ' (Confidence: '
  || format('{:.2f}', (v.id % 100) / 100.0::DOUBLE) || ')]'
  || chr(10) || chr(10) || 'HISTORICAL EVIDENCE:' || chr(10) || coalesce(e.blocks, 'None found. (Escalate: there is no evidence)')
  || chr(10) || chr(10) || 'INSTRUCTIONS:' || chr(10) || 'Draft a reply from the HISTORICAL EVIDENCE only. Answer with one JSON object with the fields reply, '
  || 'grounded_claims, evidence_ids, needs_escalation and grounding_confidence (0.0 to 1.0).' || chr(10) || 'Return ONLY valid JSON.' AS prompt
FROM vectors v LEFT JOIN evidence e ON e.q_id = v.id WHERE v.reply = '')"""))
def p24(spark, sf_dir):
    v = st.vectors(spark, sf_dir)
    return retrieval.prompts(v.withColumn("confidence", (F.col("id") % 100) / 100.0).withColumn("context", F.col("reply")), _hits(spark, sf_dir), v)

