"""Queries on escalation, drafting, evaluation metrics and the golden set."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import UNCONFIGURED_LIMITS
from ..functions import rules
from ..operators import baselines, decisions, golden, metrics
from ..plans import evaluation, triage
from ..session import staged
from ..sources import standins as st
from . import sql as s
from .registry import query
from .similarity import DIM, _docs, _flagged, _hits, _pool, _RELEVANT

# --------------------------------------------------------------- escalation

_DECISION_SQL = f"""
SELECT tweet_id, decision_source <> 'policy_and_confidence_gate' AS should_escalate,
  CASE WHEN decision_source = 'policy_and_confidence_gate' THEN 'AUTO_HANDLE' ELSE 'ESCALATE_TO_HUMAN' END AS decision, decision_source,
  {s.DECISION_SCORE} AS escalation_score, 0.5::DOUBLE AS escalation_threshold, asked, found <> '' AS sensitive, unsure, weak, advised,
  CASE WHEN decision_source = 'sensitive_content' THEN 'Sensitive keywords detected: ' || found
       WHEN decision_source = 'explicit_human_request' THEN {s.q(rules.HUMAN_REASON)}
       WHEN decision_source = 'llm_recommendation' THEN {s.q(rules.GENERATOR_REASON)}
       WHEN decision_source = 'insufficient_evidence' AND no_case THEN {s.q(rules.NO_CASES_REASON)}
       WHEN decision_source = 'insufficient_evidence' THEN format('Low retrieval quality (best similarity: {{:.2f}} < @quality)', best_score)
       WHEN decision_source = 'low_intent_confidence' THEN format('Low intent confidence ({{:.2f}} < threshold @confidence)', coalesce(intent_confidence, 0)::DOUBLE) END AS reason
FROM decided"""


def _decision_sql(confidence: float = 0.4, quality: float = 0.3) -> str:
    return _DECISION_SQL.replace("@confidence", str(confidence)).replace("@quality", str(quality))


def _decision_columns(df):
    """Signals side by side."""
    sig = F.col("signals")
    return df.select(
        "tweet_id", "should_escalate", "decision", "decision_source", "escalation_score", "escalation_threshold",
        sig["explicit_human_request"].alias("asked"), sig["sensitive_content"].alias("sensitive"),
        sig["low_intent_confidence"].alias("unsure"), sig["low_retrieval_quality"].alias("weak"),
        sig["llm_recommendation"].alias("advised"), F.col("escalation_reason").alias("reason"),
    )


def _requests(spark, sf_dir):
    return st.requests(st.tweets(spark, sf_dir))


@query("d1_escalation", s.with_(s.TWEETS, s.REQUESTS, s.decided("requests"), body=_decision_sql()))
def d1(spark, sf_dir):
    return _decision_columns(decisions.decide(_requests(spark, sf_dir)))


@query("d1_escalation_unconfigured", s.with_(s.TWEETS, s.REQUESTS, s.decided("requests", 0.45, 0.35), body=_decision_sql(0.45, 0.35)))
def d1_unconfigured(spark, sf_dir):
    return _decision_columns(decisions.decide(_requests(spark, sf_dir), UNCONFIGURED_LIMITS))


@query("d4_escalation_without_generator", s.with_(s.TWEETS, s.REQUESTS, s.decided("requests", generator="false"), body=_decision_sql()))
def d4(spark, sf_dir):
    return _decision_columns(decisions.decide(_requests(spark, sf_dir).drop("generator_escalates")))


_BROKEN = """broken AS (SELECT tweet_id, text, CASE WHEN tweet_id % 3 <> 0 THEN intent_confidence END AS intent_confidence,
  CASE WHEN tweet_id % 4 <> 0 THEN best_score END AS best_score, generator_escalates FROM requests)"""


@query("d11_failed_stages_escalate", s.with_(s.TWEETS, s.REQUESTS, _BROKEN, s.decided("broken"), body=_decision_sql()))
def d11(spark, sf_dir):
    tid = F.col("tweet_id")
    broken = (
        _requests(spark, sf_dir)
        .withColumn("intent_confidence", F.when(tid % 3 != 0, F.col("intent_confidence")))
        .withColumn("best_score", F.when(tid % 4 != 0, F.col("best_score")))
    )
    return _decision_columns(decisions.decide(broken))


@query("a30_escalation_summary", s.with_(s.TWEETS, s.REQUESTS, s.decided("requests"), body=f"""
SELECT {s.count()} AS n, {s.r6("avg(CASE WHEN decision_source <> 'policy_and_confidence_gate' THEN 1 ELSE 0 END)")} AS escalation_rate,
  {s.r6(f'avg({s.DECISION_SCORE})')} AS mean_score FROM decided"""))
def a30(spark, sf_dir):
    return metrics.escalation_summary(decisions.decide(_requests(spark, sf_dir)))


# ----------------------------------------------------------- drafts and triage

_DRAFTED = f"""
best AS (SELECT q_id, count(*) AS n_cases, arg_min(d_id, "rank") AS d_id, arg_min(score, "rank") AS top_score, max(score) AS best_score
  FROM hits WHERE score >= 0.3::DOUBLE GROUP BY q_id),
drafted AS (
  SELECT v.id, v.text, v.intent, (v.id % 100) / 100.0::DOUBLE AS intent_confidence, coalesce(b.n_cases, 0) AS n_cases, b.best_score,
    CASE WHEN b.q_id IS NULL THEN {s.q(rules.NO_EVIDENCE[0])} WHEN {s.any_of('lower(d.reply)', rules.FORBIDDEN_CLAIMS)} THEN {s.q(rules.UNGROUNDED[0])} ELSE d.reply END AS reply,
    CASE WHEN b.q_id IS NULL OR {s.any_of('lower(d.reply)', rules.FORBIDDEN_CLAIMS)} THEN 0 ELSE least(b.top_score, 1) END AS confidence,
    b.q_id IS NULL OR {s.any_of('lower(d.reply)', rules.FORBIDDEN_CLAIMS)} AS escalate,
    CASE WHEN b.q_id IS NULL THEN {s.q(rules.NO_EVIDENCE[2])} WHEN {s.any_of('lower(d.reply)', rules.FORBIDDEN_CLAIMS)} THEN {s.q(rules.UNGROUNDED[2])} END AS reason
  FROM vectors v LEFT JOIN best b ON b.q_id = v.id LEFT JOIN vectors d ON d.id = b.d_id
)"""


@query("d2_draft_replies", s.with_(s.VECTORS, s.reranked(), _DRAFTED, body=f"""
SELECT id, reply, {s.r6('confidence')} AS confidence, escalate, reason, n_cases FROM drafted"""))
def d2(spark, sf_dir):
    v = st.vectors(spark, sf_dir)
    return decisions.draft_replies(v, _hits(spark, sf_dir), v).drop("summary")


@query("d2_generated_drafts", s.with_(s.VECTORS, s.reranked(), _DRAFTED, body=f"""
SELECT id, CASE WHEN n_cases = 0 THEN {s.q(rules.NO_EVIDENCE[0])} WHEN id % 3 <> 0 THEN 'Draft for ' || id WHEN id % 2 = 0 THEN 'Retry for ' || id
    ELSE {s.q(rules.UNGROUNDED[0])} END AS reply,
  {s.r6("CASE WHEN n_cases = 0 OR (id % 3 = 0 AND id % 2 <> 0) THEN 0 ELSE 0.5 END")} AS confidence,
  CASE WHEN n_cases = 0 OR (id % 3 = 0 AND id % 2 <> 0) THEN true ELSE false END AS escalate FROM drafted"""))
def d2_generated(spark, sf_dir):
    i = F.col("id")
    name = i.cast("string")
    draft = F.when(i % 3 == 0, "I have fixed this for you").otherwise(F.concat(F.lit("Draft for "), name))
    retry = F.when(i % 2 == 0, F.concat(F.lit("Retry for "), name)).otherwise("I fixed this again")
    v = st.vectors(spark, sf_dir)
    q = v.withColumn("draft", F.to_json(F.struct(draft.alias("reply")))).withColumn("retry_draft", F.to_json(F.struct(retry.alias("reply"))))
    return decisions.draft_replies(q, _hits(spark, sf_dir), v).select("id", "reply", "confidence", "escalate")


_TRIAGE = (s.VECTORS, s.reranked(), _DRAFTED, s.decided("drafted", generator="escalate"))


def _triaged(spark, sf_dir, pool=None):
    v = st.vectors(spark, sf_dir)
    return triage.triage(v.withColumn("intent_confidence", (F.col("id") % 100) / 100.0), v, DIM, skip_same=True, pool=pool)


@query("d3_triage", s.with_(*_TRIAGE, body=f"""
SELECT id, intent, reply, {s.r6('best_score')} AS best_score, n_cases, decision_source, {s.DECISION_SCORE} AS escalation_score FROM decided"""))
def d3(spark, sf_dir):
    return _triaged(spark, sf_dir).select("id", "intent", "reply", "best_score", "n_cases", "decision_source", "escalation_score")


_TRUE = "CASE WHEN id % 5 = 0 THEN 'playback_issues' ELSE intent END"


@query("d5_golden_triage", s.with_(*_TRIAGE, body=f"""
SELECT {s.r6(f'avg(CASE WHEN {_TRUE} = intent THEN 1 ELSE 0 END)')} AS accuracy, {s.count()} AS n,
  {s.r6("avg(CASE WHEN decision_source <> 'policy_and_confidence_gate' THEN 1 ELSE 0 END)")} AS escalation_rate,
  {s.r6(f'avg({s.DECISION_SCORE})')} AS mean_score FROM decided"""))
def d5(spark, sf_dir):
    truth = F.when(F.col("id") % 5 == 0, "playback_issues").otherwise(F.col("intent"))
    gold = st.vectors(spark, sf_dir).select("id", truth.alias("true_intent"))
    return triage.evaluate_golden(_triaged(spark, sf_dir), gold).agg(
        F.avg((F.col("truth") == F.col("prediction")).cast("int")).alias("accuracy"), F.count("*").alias("n"),
        F.avg(F.col("should_escalate").cast("int")).alias("escalation_rate"), F.avg("escalation_score").alias("mean_score"),
    )


_STORE = """
keyed AS (SELECT tweet_id AS id, text, author_id AS intent, tweet_id % 3 AS n_cases, md5(text || '|' || author_id || '|' || CAST(tweet_id % 3 AS VARCHAR)) AS request_key,
  'reply ' || CAST(tweet_id AS VARCHAR) AS reply, tweet_id % 4 = 0 AS escalate FROM tweets),
store AS (SELECT request_key, arg_min(reply, id) AS reply FROM keyed WHERE NOT escalate GROUP BY request_key)"""


def _keyed(spark, sf_dir):
    tid = F.col("tweet_id")
    rows = st.tweets(spark, sf_dir).select(tid.alias("id"), "text", F.col("author_id").alias("intent"), (tid % 3).alias("n_cases"))
    answers = decisions.with_request_key(rows).withColumn("reply", F.concat(F.lit("reply "), F.col("id").cast("string")))
    store = decisions.storable(answers.withColumn("confidence", F.lit(1.0)).withColumn("summary", F.lit("")).withColumn("escalate", F.col("id") % 4 == 0))
    return decisions.with_request_key(rows), store


@query("j16_reuse_answers", s.with_(s.TWEETS, _STORE, body="""
SELECT k.id, s.reply, s.reply IS NOT NULL AS from_store FROM keyed k LEFT JOIN store s ON s.request_key = k.request_key"""))
def j16(spark, sf_dir):
    return decisions.reuse_answers(*_keyed(spark, sf_dir)).select("id", "reply", "from_store")


@query("j16_open_requests", s.with_(s.TWEETS, _STORE, body="SELECT id FROM keyed WHERE request_key NOT IN (SELECT request_key FROM store)"))
def j16_open(spark, sf_dir):
    return decisions.still_open(*_keyed(spark, sf_dir)).select("id")


# -------------------------------------------------------------------- metrics

_PRED = """
p AS (SELECT doc_id AS item_id, lang AS truth, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS prediction FROM documents),
labels_ AS (SELECT truth AS label FROM p UNION SELECT prediction FROM p),
cls AS (
  SELECT label, (SELECT count(*) FROM p WHERE truth = label AND prediction = label) AS tp, (SELECT count(*) FROM p WHERE prediction = label) AS pp,
    (SELECT count(*) FROM p WHERE truth = label) AS support FROM labels_
),
pc AS (
  SELECT label, CASE WHEN pp = 0 THEN 0 ELSE tp::DOUBLE / pp END AS "precision", CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall,
    CASE WHEN pp + support = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (pp + support) END AS f1, support, tp FROM cls
)"""


@query("a17_classification", s.with_(_PRED, body=f"""
SELECT {s.r6('sum(tp)::DOUBLE / sum(support)')} AS accuracy, {s.r6('avg("precision")')} AS macro_precision, {s.r6('avg(recall)')} AS macro_recall,
  {s.r6('avg(f1)')} AS macro_f1, {s.r6('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM pc"""))
def a17(spark, sf_dir):
    return metrics.classification(st.predictions(spark, sf_dir))


@query("a18_per_class", s.with_(_PRED, body=f"""
SELECT label, {s.r6('"precision"')} AS "precision", {s.r6('recall')} AS recall, {s.r6('f1')} AS f1, support FROM pc"""))
def a18(spark, sf_dir):
    return metrics.per_class(st.predictions(spark, sf_dir)).drop("tp")


@query("a19_confusion_matrix", s.with_(_PRED, body=f"""
SELECT a.label AS truth, b.label AS prediction, (SELECT {s.count()} FROM p WHERE truth = a.label AND prediction = b.label) AS n FROM labels_ a, labels_ b"""))
def a19(spark, sf_dir):
    return metrics.confusion_matrix(st.predictions(spark, sf_dir))


@query("j15_pair_by_key", s.with_(_PRED, body=f"SELECT truth, prediction, {s.count()} AS n FROM p GROUP BY truth, prediction"))
def j15(spark, sf_dir):
    p = st.predictions(spark, sf_dir)
    paired = metrics.pair_by_key(p.select("item_id", "truth"), p.select("item_id", "prediction"))
    return metrics.confusion_counts(paired)


@query("a20_escalation_metrics", f"""
SELECT {s.r6('avg(CASE WHEN t = p THEN 1 ELSE 0 END)')} AS accuracy,
  {s.r6('coalesce(count_if(t AND p)::DOUBLE / nullif(count_if(p), 0), 0)')} AS escalation_precision,
  {s.r6('coalesce(count_if(t AND p)::DOUBLE / nullif(count_if(t), 0), 0)')} AS escalation_recall,
  {s.r6('coalesce(2.0::DOUBLE * count_if(t AND p) / nullif(count_if(p) + count_if(t), 0), 0)')} AS escalation_f1,
  {s.r6('avg(CASE WHEN t THEN 1 ELSE 0 END)')} AS escalation_rate_true, {s.r6('avg(CASE WHEN p THEN 1 ELSE 0 END)')} AS escalation_rate_predicted
FROM (SELECT toxic = 1 AS t, quality = 0 AS p FROM labels)""")
def a20(spark, sf_dir):
    return metrics.escalation_metrics(st.escalations(spark, sf_dir))


_RANKS = """
ranked_scores AS (
  SELECT *, rank() OVER (PARTITION BY dim ORDER BY human) + (count(*) OVER (PARTITION BY dim, human) - 1) / 2.0::DOUBLE AS hr,
    rank() OVER (PARTITION BY dim ORDER BY judge) + (count(*) OVER (PARTITION BY dim, judge) - 1) / 2.0::DOUBLE AS jr FROM scores
)"""
_AGREE = f"""
SELECT dim, {s.r6('avg(CASE WHEN human = judge THEN 1 ELSE 0 END)')} AS exact_agreement,
  {s.r6('avg(CASE WHEN abs(human - judge) <= 1 THEN 1 ELSE 0 END)')} AS near_agreement, {s.r6('avg(abs(human - judge))')} AS mae,
  {s.r6('coalesce(corr(human, judge), 0)')} AS pearson_r, {s.r6('corr(hr, jr)')} AS spearman_r, {s.count()} AS n_samples,
  {s.r6('avg(human)')} AS human_mean, {s.r6('avg(judge)')} AS judge_mean FROM ranked_scores GROUP BY dim"""


@query("a23_agreement", s.with_(s.SCORES, _RANKS, body=_AGREE))
def a23(spark, sf_dir):
    return metrics.agreement(st.scores(spark, sf_dir))


@query("a24_spearman", s.with_(s.SCORES, _RANKS, body=f"SELECT dim, {s.r6('corr(hr, jr)')} AS spearman_r FROM ranked_scores GROUP BY dim"))
def a24(spark, sf_dir):
    return metrics.agreement(st.scores(spark, sf_dir)).select("dim", "spearman_r")


# Student's t by the midpoint rule: with u = r the tail is the integral of 2 (1 - u^2)^(a - 1) / B(a, 1/2) from |r| to 1, a = (n - 2) / 2.
@query("a24_spearman_p_value", s.with_(s.SCORES, _RANKS, """
correlated AS (SELECT dim, corr(hr, jr) AS r, count(*) AS n, (count(*) - 2) / 2.0::DOUBLE AS a FROM ranked_scores GROUP BY dim),
steps AS (SELECT *, abs(r) + (1 - abs(r)) * (i + 0.5::DOUBLE) / 20000 AS u, (1 - abs(r)) / 20000 AS h FROM correlated, range(20000) t(i))""",
    body=f"""SELECT dim, {s.r6('any_value(r)')} AS spearman_r, CAST(any_value(n) AS BIGINT) AS n_samples,
  {s.r6('sum(2 * h * pow(1 - u * u, a - 1)) / exp(any_value(lgamma(a) + lgamma(0.5) - lgamma(a + 0.5)))')} AS spearman_p FROM steps GROUP BY dim"""))
def a24_p(spark, sf_dir):
    return metrics.with_p_value(metrics.agreement(st.scores(spark, sf_dir))).select("dim", "spearman_r", "n_samples", "spearman_p")


@query("a25_judge_aggregates", s.with_(s.SCORES, body=f"""
SELECT dim, {s.r6('avg(j)')} AS mean, {s.r6('stddev_pop(j)')} AS std, {s.r6('min(j)')} AS "min", {s.r6('max(j)')} AS "max", {s.count()} AS n
FROM (SELECT dim, CASE WHEN item_id % 5 = 0 THEN 3 ELSE judge END AS j FROM scores) GROUP BY dim"""))
def a25(spark, sf_dir):
    long = st.scores(spark, sf_dir).select("dim", F.when(F.col("item_id") % 5 != 0, F.col("judge")).alias("score"))
    return metrics.aggregate_judge(long)


def _approaches(spark, sf_dir, triaged=None):
    """The answers of all approaches to the same messages; none may answer from the message itself."""
    asks = st.vectors(spark, sf_dir).select("id", "text")
    triaged = _triaged(spark, sf_dir) if triaged is None else triaged
    keep = ("id", "reply", "confidence", "should_escalate")
    trivial = baselines.canned(asks).select(F.lit("trivial").alias("approach"), *keep, F.lit(None).cast("double").alias("similarity"))
    simple = baselines.nearest_reply(asks, _docs(spark, sf_dir), skip_same=True).select(F.lit("simple").alias("approach"), *keep, F.col("confidence").alias("similarity"))
    system = triaged.select(F.lit("system").alias("approach"), "id", "reply", F.col("intent_confidence").alias("confidence"), "should_escalate", F.col("best_score").alias("similarity"))
    return trivial.unionByName(simple).unionByName(system)


_ASKED = s.tfidf("b", "documents", "doc_id", "text", 2, 0.9, 10_000, False, apply_to=("vectors", "id", "text"))
_SIMILAR = """
cosine AS (
  SELECT a.id AS q_id, d.id AS d_id, round(sum(a.w * d.w), 9) AS score FROM bo_weights a JOIN b_weights d USING (term) WHERE a.id <> d.id GROUP BY a.id, d.id
),
nearest AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, d_id) AS "rank" FROM cosine WHERE score >= 1e-9)
"""
_APPROACHES = f"""
approaches AS (
  SELECT 'trivial' AS approach, id, {s.q(rules.CANNED_REPLIES['default'])} AS reply, 0.1::DOUBLE AS confidence, false AS should_escalate, NULL::DOUBLE AS similarity FROM vectors
  UNION ALL
  SELECT 'simple', v.id, coalesce(d.source, ''), coalesce(n.score, 0), coalesce(n.score, 0) < 0.1::DOUBLE, coalesce(n.score, 0)
  FROM vectors v LEFT JOIN nearest n ON n.q_id = v.id AND n."rank" = 1 LEFT JOIN documents d ON d.doc_id = n.d_id
  UNION ALL
  SELECT 'system', id, reply, intent_confidence, decision_source <> 'policy_and_confidence_gate', best_score FROM decided
)"""


@query("a26_compare_approaches", s.with_(*_TRIAGE, _ASKED, _SIMILAR, _APPROACHES, body=f"""
SELECT approach, {s.count()} AS n, {s.r6('avg(confidence)')} AS mean_confidence, {s.r6('avg(CASE WHEN should_escalate THEN 1 ELSE 0 END)')} AS escalation_rate,
  {s.r6('avg(length(reply))')} AS mean_reply_chars, {s.r6('avg(similarity)')} AS mean_similarity FROM approaches GROUP BY approach"""))
def a26(spark, sf_dir):
    return metrics.compare_approaches(_approaches(spark, sf_dir))


@query("u4_concatenated_approaches", s.with_(*_TRIAGE, _ASKED, _SIMILAR, _APPROACHES, body=f"SELECT approach, id, reply, {s.r6('confidence')} AS confidence, should_escalate FROM approaches"))
def u4(spark, sf_dir):
    return _approaches(spark, sf_dir).drop("similarity")


_COMPARED = f"""
compared AS (
  SELECT approach, {s.count()} AS n, {s.r6('avg(confidence)')} AS mean_confidence, {s.r6('avg(CASE WHEN should_escalate THEN 1 ELSE 0 END)')} AS escalation_rate,
    {s.r6('avg(length(reply))')} AS mean_reply_chars, {s.r6('avg(similarity)')} AS mean_similarity FROM approaches GROUP BY approach
)"""
_COMPARED_METRICS = ("n", "mean_confidence", "escalation_rate", "mean_reply_chars", "mean_similarity")
_RANKING_METRICS = {f"{kind}_at_{k}": f"avg({value})" for k in (1, 3, 5) for kind, value in (
    ("recall", f"CASE WHEN n > 0 THEN hit{k}::DOUBLE / n END"), ("precision", f"hit{k}::DOUBLE / greatest(got{k}, 1)"))} | {"mrr": "avg(coalesce(1.0::DOUBLE / first_hit, 0))"}


@query("d10_quick_evaluation", s.with_(
    *_TRIAGE, _PRED, _ASKED, _SIMILAR, _APPROACHES, _COMPARED, _RELEVANT, body=f"""
SELECT 'intent' AS section, unnest(['accuracy', 'macro_precision', 'macro_recall', 'macro_f1', 'weighted_f1']) AS metric,
  unnest([{s.r6('sum(tp)::DOUBLE / sum(support)')}, {s.r6('avg("precision")')}, {s.r6('avg(recall)')}, {s.r6('avg(f1)')}, {s.r6('sum(f1 * support) / sum(support)')}]) AS value FROM pc
UNION ALL SELECT 'retrieval', unnest(['mean_top1', 'n_queries']), unnest([{s.r6('avg(score)')}, count(*)::DOUBLE]) FROM hits WHERE "rank" = 1
UNION ALL SELECT 'approach', approach || '.' || unnest([{", ".join(f"'{m}'" for m in _COMPARED_METRICS)}]), unnest([{", ".join(f"{m}::DOUBLE" for m in _COMPARED_METRICS)}]) FROM compared
UNION ALL SELECT 'retrieval', unnest([{", ".join(f"'{m}'" for m in _RANKING_METRICS)}]), unnest([{", ".join(s.r6(v) for v in _RANKING_METRICS.values())}]) FROM per_q
UNION ALL SELECT 'escalation', unnest(['n', 'escalation_rate', 'mean_score']), unnest([count(*)::DOUBLE,
  {s.r6("avg(CASE WHEN decision_source <> 'policy_and_confidence_gate' THEN 1 ELSE 0 END)")}, {s.r6(f'avg({s.DECISION_SCORE})')}]) FROM decided"""))
def d10(spark, sf_dir):
    """Searched once and triaged once, over the same messages for all approaches."""
    pool = staged(_pool(spark, sf_dir), "pool")
    triaged = staged(_triaged(spark, sf_dir, pool), "triaged")
    flagged, n_relevant = _flagged(spark, sf_dir, pool)
    return evaluation.quick_report(
        predictions=st.predictions(spark, sf_dir), approaches=_approaches(spark, sf_dir, triaged), hits=_hits(spark, sf_dir, pool),
        flagged_hits=flagged, n_relevant=n_relevant, decisions=triaged,
    )


# ----------------------------------------------------------------- golden set

TARGET = 200
_ALLOC = f"""
counts AS (SELECT lang AS intent, count(*) AS c FROM documents GROUP BY lang),
base AS (
  SELECT intent, c, least(greatest(greatest(5, {TARGET} // ((SELECT count(*) FROM counts) * 3)), {TARGET} * c // (SELECT sum(c) FROM counts)), c) AS b,
    row_number() OVER (ORDER BY c DESC, intent) AS place FROM counts
),
alloc AS (SELECT intent, c, CAST(b + greatest(0, least(5, {TARGET} - (SELECT sum(b) FROM base) - 5 * (place - 1))) AS BIGINT) AS n FROM base)"""


def _counts(spark, sf_dir):
    return st.strata(spark, sf_dir).groupBy("intent").agg(F.count("*").alias("c"))


@query("w8_stratum_allocation", s.with_(_ALLOC, body="SELECT intent, c, n FROM alloc"))
def w8(spark, sf_dir):
    return golden.allocate(_counts(spark, sf_dir), TARGET)


_STRATA = """
meds AS (SELECT lang AS intent, median(length(text)) AS mid FROM documents GROUP BY lang),
pooled AS (
  SELECT d.doc_id, d.lang AS intent, a.c, a.n, md5('42:' || CAST(d.doc_id AS VARCHAR)) AS h,
    length(d.text) > m.mid * 0.5::DOUBLE AND length(d.text) < m.mid * 1.5::DOUBLE AS common
  FROM documents d JOIN alloc a ON a.intent = d.lang JOIN meds m ON m.intent = d.lang
),
rn1 AS (SELECT *, row_number() OVER (PARTITION BY intent, common ORDER BY h, doc_id) AS rn FROM pooled),
tagged AS (
  SELECT *, CASE WHEN c <= n THEN 'whole' WHEN common AND rn <= floor(n * 0.6::DOUBLE) THEN 'common'
    WHEN NOT common AND rn <= floor(n * 0.2::DOUBLE) THEN 'rare' END AS pool FROM rn1
),
rest AS (SELECT *, row_number() OVER (PARTITION BY intent, pool IS NULL ORDER BY h, doc_id) AS r2 FROM tagged),
chosen AS (
  SELECT doc_id, intent, coalesce(pool, 'further') AS pool FROM rest
  WHERE pool IS NOT NULL OR r2 <= n - floor(n * 0.6::DOUBLE) - floor(n * 0.2::DOUBLE)
),
golden AS (SELECT doc_id, intent, pool FROM chosen ORDER BY md5('43:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT """ + str(TARGET) + ")"


@query("w9_stratified_sample", s.with_(_ALLOC, _STRATA, body="SELECT doc_id AS conversation_id, intent, pool FROM chosen"))
def w9(spark, sf_dir):
    return golden.sample_strata(st.strata(spark, sf_dir), TARGET)


@query("w10_shuffle_and_trim", s.with_(_ALLOC, _STRATA, body="SELECT doc_id AS conversation_id, intent, pool FROM golden"))
def w10(spark, sf_dir):
    return golden.shuffle_and_trim(golden.sample_strata(st.strata(spark, sf_dir), TARGET), TARGET)


_DIFFICULTY = f"""CASE WHEN length(text) < 50 THEN 'easy' WHEN length(text) > 200 THEN 'hard'
  WHEN contains(text, '?') AND {s.any_of('lower(text)', rules.QUESTION_WORDS)} THEN 'medium' WHEN {s.any_of('lower(text)', rules.HARD_WORDS)} THEN 'hard' ELSE 'medium' END"""
_RECORD = f"""d.doc_id AS conversation_id, d.text AS customer_message, {{intent}} AS true_intent, '' AS historical_response, '' AS conversation_context,
  {_DIFFICULTY} AS difficulty, '{{kind}}' AS sampling_category, {{intent}} AS machine_suggested_intent, {{note}} AS machine_suggestion_note,
  '' AS expected_escalation, '' AS expected_reasoning, '' AS human_verified_intent, '' AS human_verified_escalation, '' AS human_notes, false AS is_human_verified"""
_GOLD_SELECT = f"SELECT {_RECORD.format(intent='d.lang', kind='stratified', note=s.q(rules.MACHINE_NOTE))} FROM documents d JOIN golden g ON g.doc_id = d.doc_id"


def _golden(spark, sf_dir):
    return golden.build_golden_set(st.strata(spark, sf_dir), TARGET)


@query("d9_golden_set", s.with_(_ALLOC, _STRATA, body=_GOLD_SELECT))
def d9(spark, sf_dir):
    return _golden(spark, sf_dir)


@query("w13_random_golden_set", f"""
WITH golden AS (SELECT doc_id FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT {TARGET})
SELECT {_RECORD.format(intent="''", kind='random', note=s.q(rules.NO_MACHINE_NOTE))} FROM documents d JOIN golden g ON g.doc_id = d.doc_id""")
def w13(spark, sf_dir):
    return golden.build_golden_set(st.strata(spark, sf_dir).drop("intent"), TARGET)


@query("a27_golden_distributions", s.with_(_ALLOC, _STRATA, f"gold AS ({_GOLD_SELECT})", body=f"""
SELECT 'intent' AS kind, true_intent AS value, {s.count()} AS n FROM gold GROUP BY true_intent
UNION ALL SELECT 'difficulty', difficulty, {s.count()} FROM gold GROUP BY difficulty
UNION ALL SELECT 'verified', CAST(is_human_verified AS VARCHAR), {s.count()} FROM gold GROUP BY is_human_verified"""))
def a27(spark, sf_dir):
    return golden.distributions(_golden(spark, sf_dir))


@query("j8_exclude_golden", s.with_(_ALLOC, _STRATA, body="SELECT doc_id AS conversation_id, lang AS intent FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM golden)"))
def j8(spark, sf_dir):
    return golden.exclude_golden(st.strata(spark, sf_dir), _golden(spark, sf_dir)).select("conversation_id", "intent")


def _review(spark, sf_dir):
    return golden.review_table(golden.golden_records(st.strata(spark, sf_dir), True))


_REVIEW = f"""
review AS (SELECT doc_id AS conversation_id, text AS customer_message, lang AS true_intent, '' AS conversation_context, '' AS historical_response,
  {_DIFFICULTY} AS difficulty, 'stratified' AS sampling_category, lang AS machine_suggested_intent, false AS machine_suggested_escalation,
  {s.q(rules.REVIEW_PENDING)} AS machine_reason FROM documents),
updated AS (SELECT r.*, l.doc_id IS NOT NULL AS human_reviewed, 'q' || CAST(l.quality AS VARCHAR) AS human_intent, l.toxic = 1 AS human_escalation,
  CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 1 THEN 'toxic' END AS human_reason FROM review r LEFT JOIN labels l ON l.doc_id = r.conversation_id)"""


@query("p31_review_table", s.with_(_REVIEW, body="""
SELECT *, CAST(NULL AS VARCHAR) AS human_intent, CAST(NULL AS BOOLEAN) AS human_escalation, CAST(NULL AS VARCHAR) AS human_reason, false AS human_reviewed,
  CAST(NULL AS VARCHAR) AS reviewer_notes FROM review"""))
def p31(spark, sf_dir):
    return _review(spark, sf_dir)


def _updates(spark, sf_dir):
    """Two updates per labelled document, the second one counting."""
    l = st.table(spark, sf_dir, "labels")
    last = l.select(
        F.col("doc_id").alias("conversation_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("human_intent"),
        (F.col("toxic") == 1).alias("human_escalation"), F.when(F.col("toxic") == 1, "toxic").alias("human_reason"),
        F.lit(None).cast("string").alias("reviewer_notes"), F.lit(2).alias("seq"),
    )
    first = last.withColumn("human_intent", F.lit("first")).withColumn("seq", F.lit(1))
    return first.unionByName(last)


def _updated(spark, sf_dir):
    return golden.apply_updates(_review(spark, sf_dir), _updates(spark, sf_dir), "seq", strict=False)


@query("j10_apply_updates", s.with_(_REVIEW, body="SELECT conversation_id, human_intent, human_escalation, human_reason, human_reviewed FROM updated"))
def j10(spark, sf_dir):
    return _updated(spark, sf_dir).select("conversation_id", "human_intent", "human_escalation", "human_reason", "human_reviewed")


@query("j10_unknown_updates", s.with_(_ALLOC, _STRATA, body="SELECT doc_id AS conversation_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM golden)"))
def j10_unknown(spark, sf_dir):
    return golden.unknown_updates(_golden(spark, sf_dir), _updates(spark, sf_dir))


@query("p33_unreviewed", s.with_(_REVIEW, body="SELECT conversation_id FROM updated WHERE NOT human_reviewed"))
def p33(spark, sf_dir):
    return golden.unreviewed(_updated(spark, sf_dir)).select("conversation_id")


@query("a28_reviewed_subset", s.with_(_REVIEW, body="SELECT conversation_id, human_intent FROM updated WHERE human_reviewed"))
def a28_subset(spark, sf_dir):
    return golden.reviewed(_updated(spark, sf_dir)).select("conversation_id", "human_intent")


@query("a28_review_progress", s.with_(_REVIEW, body=f"""
SELECT {s.count()} AS total, CAST(count_if(human_reviewed) AS BIGINT) AS reviewed, {s.pct2('count_if(human_reviewed)', 'count(*)')} AS reviewed_pct FROM updated"""))
def a28(spark, sf_dir):
    return golden.progress(_updated(spark, sf_dir))
