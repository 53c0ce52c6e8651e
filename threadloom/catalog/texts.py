"""Queries on single texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import judgement, parsing, rules, text as tx
from ..operators import decisions, golden, metrics
from ..plans import preparation
from ..sources import standins as st, tweets as raw
from . import sql as s
from .registry import query


def _tweets(name: str, sql_cols: str, *cols):
    """Query of expressions over all tweets; `cols` build the columns once a session runs."""
    body = f"SELECT tweet_id, {sql_cols} FROM tweets"

    @query(name, s.with_(s.TWEETS, body=body))
    def run(spark, sf_dir):
        return st.tweets(spark, sf_dir).select("tweet_id", *[c() for c in cols])


def T():
    return F.col("text")

_tweets("p1_extract_mention", f"{s.mention(s.strip('text'))} AS mention", lambda: tx.extract_mention(T()).alias("mention"))
_tweets("p2_target_mention", f"{s.mention('text')} AS target", lambda: tx.extract_mention(T(), strip_first=False).alias("target"))
_tweets("p3_clean_text", f"{s.clean('text')} AS clean", lambda: tx.clean_text(T()).alias("clean"))
_tweets("p4_clean_text_keep_space", f"{s.clean_keep_space('text')} AS clean", lambda: tx.clean_text(T(), collapse=False).alias("clean"))


def _clustering_sql(x: str) -> str:
    t = f"lower({x})"
    for pattern, put in ((r"@[\p{L}\p{N}_]+", ""), (r"https?://\S+", ""), (r"\[url\]", ""), (r"[^a-z0-9\s.,!?]", " "), (r"\s+", " ")):
        t = f"regexp_replace({t}, '{pattern}', '{put}', 'g')"
    return s.strip(t)


_tweets("p5_clean_for_clustering", f"{_clustering_sql('text')} AS clean", lambda: tx.clean_for_clustering(T()).alias("clean"))
_OPENING = r"regexp_split_to_array(" + s.strip(f"regexp_replace(text, '^@{s.NAME}{s.SPACE}*', '')") + f", '{s.SPACE}+')"
_tweets("p6_opening_words", f"array_to_string({_OPENING}[1:3], ' ') AS opening", lambda: tx.opening_words(T()).alias("opening"))
_tweets(
    "p7_conversation_id",
    "substr(md5(CAST(tweet_id AS VARCHAR) || '_' || CAST(tweet_id + 1 AS VARCHAR)), 1, 12) AS conversation_id",
    lambda: tx.conversation_id(F.col("tweet_id"), F.col("tweet_id") + 1).alias("conversation_id"),
)


@query("p8_stage_tweets", s.with_(s.TWEETS, body="""
SELECT CAST(tweet_id AS VARCHAR) AS tweet_id, author_id, inbound AS is_inbound, created_at, text AS tweet_text, response_tweet_id,
  in_response_to_tweet_id, CASE WHEN NOT inbound THEN author_id END AS brand_id FROM tweets WHERE text IS NOT NULL"""))
def p8(spark, sf_dir):
    return raw.stage(st.tweets(spark, sf_dir))


_IDS = """list_filter(list_transform(string_split(response_tweet_id, ','), lambda x: TRY_CAST(TRY_CAST(x AS DOUBLE) AS BIGINT)),
  lambda y: y IS NOT NULL)"""
_tweets(
    "p10_parse_reply_ids",
    f"array_to_string({_IDS}, ',') AS ids, {_IDS}[-1] AS last_id, {_IDS}[1] AS first_id",
    lambda: F.array_join(F.transform(tx.parse_id_list(F.col("response_tweet_id")), lambda x: x.cast("string")), ",").alias("ids"),
    lambda: tx.last_id(F.col("response_tweet_id")).alias("last_id"), lambda: tx.first_id(F.col("response_tweet_id")).alias("first_id"),
)
_tweets("p11_text_lengths", f"length(text) AS chars, CAST({s.n_words('text')} AS BIGINT) AS words", lambda: tx.char_count(T()).alias("chars"), lambda: tx.word_count(T()).alias("words"))
_tweets(
    "p12_parse_created_at",
    "strftime(try_strptime(substr(created_at, 5), '%b %d %H:%M:%S +0000 %Y'), '%Y-%m-%d %H:%M:%S') AS at",
    lambda: F.date_format(tx.parse_created_at(F.col("created_at")), "yyyy-MM-dd HH:mm:ss").alias("at"),
)
_tweets("p13_dm_redirect", f"regexp_matches(text, {s.q(s.DM)}) AS is_dm", lambda: tx.is_dm_redirect(T()).alias("is_dm"))
_SHORT = f"length({s.strip(s.clean('text'))}) > 5"
_tweets(
    "p14_usability", f"{_SHORT} AS long_message, {s.n_words(s.clean('text'))} >= 3 AS enough_words",
    lambda: tx.usable(tx.clean_text(T()), T())[0].alias("long_message"), lambda: tx.usable(tx.clean_text(T()), T())[2].alias("enough_words"),
)


@query("p15_difficulty", f"""
SELECT doc_id, CASE WHEN length(text) < 50 THEN 'easy' WHEN length(text) > 200 THEN 'hard'
  WHEN contains(text, '?') AND {s.any_of('lower(text)', rules.QUESTION_WORDS)} THEN 'medium'
  WHEN {s.any_of('lower(text)', rules.HARD_WORDS)} THEN 'hard' ELSE 'medium' END AS difficulty FROM documents""")
def p15(spark, sf_dir):
    return st.documents(spark, sf_dir).select("doc_id", judgement.difficulty(T()).alias("difficulty"))


_CTX = s.strip("conversation_context")


@query("p16_context_prefix", s.with_(*s.ALL_CONVERSATIONS, body=f"""
SELECT conversation_id, CASE WHEN {_CTX} <> '' THEN right({_CTX}, 200) || ' ' || customer_message ELSE customer_message END AS input FROM convs"""))
def p16(spark, sf_dir):
    conv = preparation.raw_conversations(st.tweets(spark, sf_dir))
    return conv.select("conversation_id", tx.with_context(F.col("conversation_context"), F.col("customer_message")).alias("input"))


def _naming_sql(joined: str) -> str:
    rows = [
        "SELECT id, " + " + ".join(f"CASE WHEN contains(joined, {s.q(w)}) THEN 1 ELSE 0 END" for w in words)
        + f" AS hits, {i} AS place, {s.q(name)} AS name FROM joined"
        for i, (name, words) in enumerate(rules.INTENT_KEYWORDS.items())
    ]
    return f"""joined AS ({joined}), scored AS ({' UNION ALL '.join(rows)}),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, place) AS rn FROM scored),
named AS (SELECT id, CASE WHEN hits > 0 THEN name ELSE '{rules.DEFAULT_INTENT}' END AS name FROM best WHERE rn = 1)"""


_WORDS = r"regexp_split_to_array(" + s.strip("lower(text)") + r", '\s+')"


@query("p17_name_from_terms", s.with_(
    s.TWEETS, _naming_sql(f"SELECT tweet_id AS id, array_to_string({_WORDS}[1:10], ' ') AS joined FROM tweets"),
    body="SELECT id AS tweet_id, name FROM named"))
def p17(spark, sf_dir):
    words = F.split(tx.strip(F.lower("text")), r"\s+")
    return st.tweets(spark, sf_dir).select("tweet_id", judgement.name_cluster(words).alias("name"))


_tweets("p18_sensitive_keywords", f"{s.sensitive('lower(text)')} AS found", lambda: F.array_join(judgement.sensitive_found(T()), ", ").alias("found"))
_tweets("p19_human_request", f"regexp_matches({s.strip('lower(text)')}, {s.q(s.HUMAN)}) AS asks", lambda: judgement.asks_for_human(T()).alias("asks"))
_DRAFT = "CASE WHEN tweet_id % 7 = 0 THEN 'I have fixed this. ' ELSE '' END || text"


def _draft():
    return F.concat(F.when(F.col("tweet_id") % 7 == 0, "I have fixed this. ").otherwise(""), T())



_tweets("p20_grounding", f"NOT {s.any_of(f'lower({_DRAFT})', rules.FORBIDDEN_CLAIMS)} AS grounded", lambda: judgement.is_grounded(_draft()).alias("grounded"))
_INTENT = "CASE tweet_id % 4 WHEN 0 THEN 'playback_issues' WHEN 1 THEN 'account_access' WHEN 2 THEN 'billing_payment' ELSE 'other' END"


def _intent():
    rest = F.col("tweet_id") % 4
    return (
        F.when(rest == 0, "playback_issues").when(rest == 1, "account_access")
        .when(rest == 2, "billing_payment").otherwise("other")
    )



_ALIGN = " OR ".join(
    f"({_INTENT} = {s.q(i)} AND ({s.any_of('lower(text)', w)} OR {s.any_of('lower(author_id)', w)}))" for i, w in rules.INTENT_ALIGNMENT.items()
)
_tweets("p21_intent_alignment", f"({_ALIGN}) AS aligned", lambda: judgement.intent_aligned(_intent(), T(), F.col("author_id")).alias("aligned"))

_APPLIES = (
    f"{s.any_of('lower(conversation_context)', rules.OVERRIDE_CONTEXT_WORDS)} AND {s.any_of('lower(raw_message)', rules.OVERRIDE_MESSAGE_WORDS)}"
    " AND (intent = 'other' OR confidence < 0.6::DOUBLE)"
)


@query("p22_account_override", s.with_(*s.ALL_CONVERSATIONS, """
scored AS (
  SELECT conversation_id, conversation_context || CASE WHEN customer_tweet_id % 2 = 0 THEN ' your login' ELSE '' END AS conversation_context,
    customer_message || CASE WHEN customer_tweet_id % 3 = 0 THEN ' me@mail' ELSE '' END AS raw_message,
    CASE WHEN customer_tweet_id % 5 = 0 THEN 'other' ELSE 'billing_payment' END AS intent,
    (customer_tweet_id % 100) / 100.0::DOUBLE AS confidence
  FROM convs
)""", body=f"""
SELECT conversation_id, CASE WHEN {_APPLIES} THEN 'account_access' ELSE intent END AS intent,
  {s.r6(f"CASE WHEN {_APPLIES} THEN greatest(confidence, 0.75::DOUBLE) ELSE confidence END")} AS confidence FROM scored"""))
def p22(spark, sf_dir):
    tid = F.col("customer_tweet_id")
    conv = preparation.raw_conversations(st.tweets(spark, sf_dir)).select(
        "conversation_id",
        F.concat("conversation_context", F.when(tid % 2 == 0, " your login").otherwise("")).alias("context"),
        F.concat("customer_message", F.when(tid % 3 == 0, " me@mail").otherwise("")).alias("message"),
        F.when(tid % 5 == 0, "other").otherwise("billing_payment").alias("i"), ((tid % 100) / 100.0).alias("c"),
    )
    intent, confidence = judgement.account_override(F.col("i"), F.col("c"), F.col("context"), F.col("message"))
    return conv.select("conversation_id", intent.alias("intent"), confidence.alias("confidence"))


_SET = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"


@query("p23_word_overlap", s.with_(*s.ALL_CONVERSATIONS, body=f"""
SELECT conversation_id, CAST(len({_SET.format('customer_message')}) AS BIGINT) AS n_words,
  {s.r6(f"CASE WHEN len({_SET.format('customer_message')}) > 0 THEN len(list_intersect({_SET.format('customer_message')}, {_SET.format('historical_support_response')}))::DOUBLE / len({_SET.format('customer_message')}) ELSE 0 END")} AS share
FROM convs"""))
def p23(spark, sf_dir):
    q, d = tx.word_set(F.col("customer_message")), tx.word_set(F.col("historical_support_response"))
    return preparation.raw_conversations(st.tweets(spark, sf_dir)).select(
        "conversation_id", F.size(q).alias("n_words"), tx.overlap_share(q, d).alias("share")
    )


def _draft_text():
    """Generator answers of every kind: empty, broken, fenced and plain."""
    t = F.col("tweet_id")
    good = F.to_json(F.struct(
        T().alias("reply"), F.array(F.col("author_id"), F.lit("claim")).alias("grounded_claims"),
        (t % 3 == 0).alias("needs_escalation"), F.when(t % 2 == 0, (t % 10) / 10.0).alias("grounding_confidence"),
    ))
    return (
        F.when(t % 5 == 0, "").when(t % 5 == 1, "no json here")
        .when(t % 5 == 2, F.concat(F.lit("Sure:\n```json\n"), good, F.lit("\n```\nbye"))).otherwise(good)
    )


_GOOD = "tweet_id % 5 IN (2, 3, 4)"


@query("p25_parse_draft", s.with_(s.TWEETS, body=f"""
SELECT tweet_id,
  CASE WHEN {_GOOD} THEN {s.strip('text')} WHEN tweet_id % 5 = 0 THEN {s.q(rules.EMPTY_DRAFT[0])} ELSE {s.q(rules.UNPARSABLE_DRAFT[0])} END AS reply,
  {s.r6(f"CASE WHEN NOT {_GOOD} THEN 0 WHEN tweet_id % 2 = 0 THEN (tweet_id % 10) / 10.0::DOUBLE ELSE 0.5 END")} AS confidence,
  CASE WHEN {_GOOD} THEN 'Claims: ' || author_id || ' | claim' WHEN tweet_id % 5 = 0 THEN {s.q(rules.EMPTY_DRAFT[1])} ELSE {s.q(rules.UNPARSABLE_DRAFT[1])} END AS summary,
  CASE WHEN {_GOOD} THEN tweet_id % 3 = 0 ELSE true END AS escalate,
  CASE WHEN {_GOOD} AND tweet_id % 3 = 0 THEN {s.q(rules.COMPLEX_REASON)} WHEN {_GOOD} THEN NULL
       WHEN tweet_id % 5 = 0 THEN {s.q(rules.EMPTY_DRAFT[2])} ELSE {s.q(rules.UNPARSABLE_DRAFT[2])} END AS reason
FROM tweets"""))
def p25(spark, sf_dir):
    return st.tweets(spark, sf_dir).select("tweet_id", parsing.parse_draft(_draft_text()).alias("d")).select("tweet_id", "d.*")


_NAMES = "[" + ", ".join(s.q(d) for d in rules.DIMENSIONS) + "]"


@query("p26_parse_judge", s.with_(s.SCORES, body=f"""
SELECT item_id, {_NAMES}[dimno + 1] AS dim, {s.r6("CASE WHEN item_id % 4 = 0 THEN 3 WHEN dimno % 2 = 0 THEN judge ELSE floor(judge + 0.5) END")} AS score
FROM scores"""))
def p26(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), F.col("judge"), F.lit("\n```"))
    text = F.when(F.col("item_id") % 4 == 0, F.lit("I cannot rate this")).when(F.col("item_id") % 4 == 1, fenced).otherwise(F.col("judge"))
    return metrics.judge_scores(st.rating_text(spark, sf_dir).withColumn("answer", text), "answer")


@query("p27_extract_scores", s.with_(s.SCORES, body=f"""
SELECT item_id, {_NAMES}[dimno + 1] AS dim, {s.r6("human")} AS human, {s.r6("judge")} AS judge FROM scores
UNION ALL SELECT doc_id, 'overall', NULL, NULL FROM labels"""))
def p27(spark, sf_dir):
    return metrics.scores_from_text(st.rating_text(spark, sf_dir))


@query("p28_request_key", s.with_(s.TWEETS, body=f"""
SELECT tweet_id, md5(text || '|' || {_INTENT} || '|' || CAST(tweet_id % 6 AS VARCHAR)) AS request_key FROM tweets"""))
def p28(spark, sf_dir):
    rows = st.tweets(spark, sf_dir).withColumn("intent", _intent()).withColumn("n_cases", F.col("tweet_id") % 6)
    return decisions.with_request_key(rows).select("tweet_id", "request_key")


_tweets(
    "p29_canned_reply",
    f"""CASE tweet_id % 3 WHEN 0 THEN {s.q(rules.CANNED_REPLIES['account'])} WHEN 1 THEN {s.q(rules.CANNED_REPLIES['technical'])}
        ELSE {s.q(rules.CANNED_REPLIES['default'])} END AS reply, 0.1::DOUBLE AS confidence""",
    lambda: judgement.canned_reply(F.when(F.col("tweet_id") % 3 == 0, "account").when(F.col("tweet_id") % 3 == 1, "technical")).alias("reply"),
    lambda: F.lit(rules.CANNED_CONFIDENCE).alias("confidence"),
)


@query("p30_annotation_template", """
SELECT row_number() OVER (ORDER BY doc_id) AS id, text AS customer_message, source AS generated_response, '' AS human_relevance,
  '' AS human_groundedness, '' AS human_correctness, '' AS human_helpfulness, '' AS human_brand_consistency, '' AS human_safety,
  '' AS human_escalation_appropriateness, '' AS human_overall, '' AS human_notes, false AS annotated, '' AS annotator FROM documents""")
def p30(spark, sf_dir):
    rows = st.documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("text").alias("customer_message"), F.col("source").alias("generated_response")
    )
    return golden.annotation_template(rows)


@query("p32_conversation_length", s.with_(*s.ALL_CONVERSATIONS, body="SELECT conversation_id, conversation_length FROM convs"))
def p32(spark, sf_dir):
    return preparation.raw_conversations(st.tweets(spark, sf_dir)).select(
        "conversation_id", tx.conversation_length(F.col("conversation_context")).alias("conversation_length")
    )
