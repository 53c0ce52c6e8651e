"""Re-ranking of similar past cases, the evidence gate and retrieval metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import RetrievalSettings
from ..functions import judgement, rules, text as tx
from ..functions.parsing import prompt_text
from ..functions.vectors import normalise


def build_documents(conversations: DataFrame, vectors: DataFrame) -> DataFrame:
    """Retrieval table: five document fields and the vector, missing text as ''.

    A conversation without a vector keeps its row; searches pass it over.
    """
    fields = ["customer_message", "historical_support_response", "conversation_context", "brand"]
    have = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in conversations.columns else F.lit("").alias(c) for c in fields]
    return conversations.select("conversation_id", *have).join(vectors, "conversation_id", "left")


def embed(df: DataFrame, text_col: str, encode, out: str = "vector") -> DataFrame:
    """Adds unit vectors; `encode` is an Arrow pandas UDF from text to array<float>."""
    return df.withColumn(out, normalise(encode(F.coalesce(F.col(text_col), F.lit("")))))


def rerank(
    hits: DataFrame, queries: DataFrame, documents: DataFrame, settings: RetrievalSettings = RetrievalSettings()
) -> DataFrame:
    """Final hits (q_id, d_id, base_score, score, rank).

    `hits` is the candidate pool (q_id, d_id, score, rank); `queries` has id, text
    (without context) and intent; `documents` has id, text and reply. The
    threshold applies to the similarity, before any boost.
    """
    pool = hits.filter(F.col("score") >= settings.min_similarity)
    q = queries.select(F.col("id").alias("q_id"), tx.word_set(F.col("text")).alias("q_words"), F.col("intent").alias("q_intent"))
    # words are cut before the join: a document is in many pools
    d = documents.select(F.col("id").alias("d_id"), tx.word_set(F.col("text")).alias("d_words"), F.col("text").alias("d_text"), F.col("reply").alias("d_reply"))
    share = tx.overlap_share(F.col("q_words"), F.col("d_words"))
    boost = F.lit(settings.overlap_boost) * share + F.when(
        judgement.intent_aligned(F.col("q_intent"), F.col("d_text"), F.col("d_reply")), settings.intent_boost
    ).otherwise(0.0)
    scored = pool.join(q, "q_id").join(d, "d_id").select(
        "q_id", "d_id", F.col("rank").alias("base_rank"), F.col("score").alias("base_score"),
        (F.col("score") + boost).alias("score"),
    )
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "base_rank")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= settings.top_k).drop("base_rank")


def evidence(hits: DataFrame, floor: float = RetrievalSettings().gate_similarity) -> DataFrame:
    """Hits good enough to rest a reply on."""
    return hits.filter(F.col("score") >= floor)


def without_evidence(queries: DataFrame, hits: DataFrame, floor: float = RetrievalSettings().gate_similarity) -> DataFrame:
    """Ids of queries the gate leaves with nothing."""
    return queries.select(F.col("id").alias("q_id")).join(evidence(hits, floor), "q_id", "left_anti")


def best_scores(hits: DataFrame) -> DataFrame:
    return hits.groupBy("q_id").agg(F.max("score").alias("best_score"), F.count("*").alias("n_cases"))


def flag_relevant(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """Marks hits listed in `relevant` (q_id, d_id)."""
    known = relevant.select("q_id", "d_id").distinct().withColumn("is_relevant", F.lit(True))
    return hits.join(known, ["q_id", "d_id"], "left").withColumn("is_relevant", F.coalesce("is_relevant", F.lit(False)))


def retrieval_metrics(flagged: DataFrame, n_relevant: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Recall and precision at k and the mean reciprocal rank, one row.

    `flagged` has (q_id, d_id, rank, is_relevant), `n_relevant` one row per query
    (q_id, n). Queries without hits count with precision and rank 0; recall skips
    queries without relevant documents.
    """
    def within(k: int) -> Column:
        return F.col("rank") <= k

    aggs = [F.min(F.when(F.col("is_relevant"), F.col("rank"))).alias("first_hit")]
    for k in ks:
        aggs.append(F.count_if(within(k) & F.col("is_relevant")).alias(f"hit{k}"))
        aggs.append(F.count_if(within(k)).alias(f"got{k}"))
    per_query = n_relevant.join(flagged.groupBy("q_id").agg(*aggs), "q_id", "left")
    out = []
    for k in ks:
        hit, got = (F.coalesce(F.col(f"{x}{k}"), F.lit(0)) for x in ("hit", "got"))
        out.append(F.coalesce(F.avg(F.when(F.col("n") > 0, hit / F.col("n"))), F.lit(0.0)).alias(f"recall_at_{k}"))
        out.append(F.avg(hit / F.greatest(got, F.lit(1))).alias(f"precision_at_{k}"))
    out.append(F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("mrr"))
    return per_query.agg(*out)


def mean_top_score(hits: DataFrame) -> DataFrame:
    """Mean score of the first hit, over queries that have one."""
    return hits.filter(F.col("rank") == 1).agg(F.avg("score").alias("mean_top1"), F.count("*").alias("n_queries"))


def prompts(queries: DataFrame, hits: DataFrame, documents: DataFrame) -> DataFrame:
    """One prompt per query with the system prompt; at most k cases are gathered per query."""
    d = documents.select(F.col("id").alias("d_id"), F.col("text").alias("customer_message"), F.col("reply").alias("case_reply"))
    cases = hits.join(d, "d_id").groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct(
        "rank", "score", "customer_message", F.col("case_reply").alias("reply"), F.lit(None).cast("string").alias("resolution")
    ))).alias("evidence"))
    empty = F.array().cast("array<struct<rank:int,score:double,customer_message:string,reply:string,resolution:string>>")
    q = queries.join(cases.withColumnRenamed("q_id", "id"), "id", "left").withColumn("evidence", F.coalesce("evidence", empty))
    return q.select("id", F.lit(rules.SYSTEM_PROMPT).alias("system"), prompt_text(*[F.col(c) for c in ("text", "intent", "confidence", "context", "evidence")]).alias("prompt"))
