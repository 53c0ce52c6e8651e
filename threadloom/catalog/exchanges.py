"""Queries that rebuild conversations and check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contract, golden, intents, threads
from ..plans import preparation
from ..session import scratch_path
from ..sources import standins as st, tables, tweets as raw
from . import sql as s
from .registry import query

_CONV_COLUMNS = (
    'conversation_id, brand, customer_message, historical_support_response, "timestamp", conversation_context, customer_author, '
    "support_author, parent_tweet_id, response_tweet_id, conversation_length"
)


def _sliced(spark, sf_dir):
    return threads.brand_slice(st.tweets(spark, sf_dir))


@query("p9_brand_slice", s.with_(s.TWEETS, s.SLICED, body="SELECT tweet_id, brand, inbound FROM sliced"))
def p9(spark, sf_dir):
    return _sliced(spark, sf_dir).select("tweet_id", "brand", "inbound")


@query("p9_one_brand_slice", s.with_(s.TWEETS, s.SLICED, body="SELECT tweet_id, inbound FROM sliced WHERE brand = 'brand1'"))
def p9_one(spark, sf_dir):
    return threads.brand_slice(st.tweets(spark, sf_dir), "Brand1").select("tweet_id", "inbound")


@query("u1_brand_message_ids", s.with_(s.TWEETS, body=f"""
SELECT lower(author_id) AS brand, tweet_id FROM tweets WHERE NOT inbound
UNION SELECT {s.mention('text')}, tweet_id FROM tweets WHERE inbound AND {s.mention('text')} IS NOT NULL"""))
def u1(spark, sf_dir):
    return _sliced(spark, sf_dir).select("brand", "tweet_id")


@query("j1_pairs_by_reply_id", s.with_(s.TWEETS, s.SLICED, s.pairs(), body="SELECT tweet_id, response_id, brand FROM m1"))
def j1(spark, sf_dir):
    return threads.pairs_by_reply_id(_sliced(spark, sf_dir)).select("tweet_id", "response_id", "brand")


@query("j1_pairs_by_first_reply_id", s.with_(s.TWEETS, s.SLICED, s.pairs("first"), body="SELECT tweet_id, response_id, brand FROM m1"))
def j1_first(spark, sf_dir):
    return threads.pairs_by_reply_id(_sliced(spark, sf_dir), pick="first").select("tweet_id", "response_id", "brand")


@query("j2_pairs_by_parent", s.with_(s.TWEETS, s.SLICED, s.pairs(), body="SELECT tweet_id, response_id, brand FROM m2"))
def j2(spark, sf_dir):
    return threads.pairs_by_parent(_sliced(spark, sf_dir)).select("tweet_id", "response_id", "brand")


@query("w2_first_brand_child", s.with_(s.TWEETS, s.SLICED, s.pairs(), body="""
SELECT in_response_to_tweet_id AS parent, brand, tweet_id AS response_id, text FROM children WHERE rn = 1"""))
def w2(spark, sf_dir):
    child = threads.first_child(_sliced(spark, sf_dir))
    texts = st.tweets(spark, sf_dir).select(F.col("tweet_id").alias("response_id"), "text")
    return child.select("parent", F.col("c_brand").alias("brand"), F.col("child_id").alias("response_id")).join(texts, "response_id")


@query("j3_pair_assembly", s.with_(s.TWEETS, s.SLICED, s.pairs(), body="""
SELECT tweet_id, response_id, brand, by_reply_id, r_text, support_author FROM pairs"""))
def j3(spark, sf_dir):
    sliced = _sliced(spark, sf_dir)
    return threads.attach_texts(threads.pair_replies(sliced), sliced).select("tweet_id", "response_id", "brand", "by_reply_id", "r_text", "support_author")


@query("j4_ancestor_context", s.with_(*s.ALL_CONVERSATIONS, body="SELECT tweet_id, response_id, conversation_context FROM ctx"))
def j4(spark, sf_dir):
    sliced = _sliced(spark, sf_dir)
    pairs = threads.ancestors(threads.pair_replies(sliced), sliced)
    return threads.attach_texts(pairs, sliced).select("tweet_id", "response_id", "conversation_context")


_STAGED = """staged AS (SELECT CAST(tweet_id AS VARCHAR) AS tweet_id, author_id, inbound, created_at, text, response_tweet_id,
  in_response_to_tweet_id FROM tweets WHERE text IS NOT NULL)"""
_SQL_JOIN = """joined AS (SELECT i.tweet_id AS conversation_id, o.author_id AS brand, i.text AS customer_message,
  o.text AS historical_support_response, i.created_at AS "timestamp", i.author_id AS customer_author, o.author_id AS support_author,
  i.in_response_to_tweet_id AS parent_tweet_id, i.response_tweet_id
  FROM staged i JOIN staged o ON i.response_tweet_id = o.tweet_id WHERE i.inbound AND NOT o.inbound)"""


@query("j5_sql_conversations", s.with_(s.TWEETS, _STAGED, _SQL_JOIN, body="SELECT * FROM joined"))
def j5(spark, sf_dir):
    return threads.sql_conversations(raw.stage(st.tweets(spark, sf_dir)))


@query("s6_published_view", s.with_(s.TWEETS, _STAGED, _SQL_JOIN, body=f"""
SELECT brand, {s.count()} AS n FROM joined GROUP BY brand"""))
def s6(spark, sf_dir):
    tables.publish_view(raw.stage(st.tweets(spark, sf_dir)), "staged_messages")
    return spark.sql("""
        SELECT o.brand_id AS brand, count(*) AS n FROM staged_messages i JOIN staged_messages o ON i.response_tweet_id = o.tweet_id
        WHERE i.is_inbound AND NOT o.is_inbound GROUP BY o.brand_id""")


@query("s6_bucketed_table", s.with_(s.TWEETS, _STAGED, _SQL_JOIN, body=f"""
SELECT brand, {s.count()} AS n FROM joined GROUP BY brand"""))
def s6_bucketed(spark, sf_dir):
    """The same from a materialised table, bucketed by the key of the join."""
    path = scratch_path(spark, "staged_messages")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    tables.publish_table(raw.stage(st.tweets(spark, sf_dir)), name, bucket_by="tweet_id", buckets=8, path=path)
    return spark.sql(f"""
        SELECT o.brand_id AS brand, count(*) AS n FROM {name} i JOIN {name} o ON i.response_tweet_id = o.tweet_id
        WHERE i.is_inbound AND NOT o.is_inbound GROUP BY o.brand_id""")


@query("w1_dedup_messages", s.with_(*s.ALL_CONVERSATIONS, body="SELECT conversation_id, brand, customer_message FROM deduped WHERE rn = 1"))
def w1(spark, sf_dir):
    rows = threads.flag_and_filter(preparation.raw_conversations(st.tweets(spark, sf_dir)), with_word_count=False)
    return threads.dedup_messages(rows).select("conversation_id", "brand", "customer_message")


@query("d6_prepare_conversations", s.with_(*s.ALL_CONVERSATIONS, body=f"SELECT {_CONV_COLUMNS}, is_dm_redirect FROM prepared"))
def d6(spark, sf_dir):
    return preparation.prepare(st.tweets(spark, sf_dir))


_FIRST = (s.TWEETS, s.SLICED, s.pairs("first"), s.CONVERSATIONS)


@query("d6_prepare_first_reply", s.with_(*_FIRST, body=f"SELECT {_CONV_COLUMNS}, is_dm_redirect FROM prepared"))
def d6_first(spark, sf_dir):
    return preparation.prepare(st.tweets(spark, sf_dir), pick="first")


@query("a15_conversation_summary", s.with_(*s.ALL_CONVERSATIONS, body=f"""
SELECT {s.count()} AS n_conversations, {s.count('DISTINCT brand')} AS n_brands, {s.r6('avg(length(customer_message))')} AS mean_message_chars,
  {s.r6('avg(length(historical_support_response))')} AS mean_reply_chars, {s.r6('avg(conversation_length)')} AS mean_length,
  max(conversation_length) AS max_length FROM prepared"""))
def a15(spark, sf_dir):
    return preparation.summarise(preparation.prepare(st.tweets(spark, sf_dir)))


@query("a16_filter_funnel", s.with_(*s.ALL_CONVERSATIONS, body=f"""
SELECT (SELECT {s.count()} FROM convs) AS initial,
  (SELECT {s.count()} FROM convs WHERE length({s.strip('customer_message')}) > 5) AS after_empty_customer,
  (SELECT {s.count()} FROM usable) AS after_empty_response, (SELECT {s.count()} FROM usable WHERE is_dm_redirect) AS dm_redirects,
  (SELECT {s.count()} FROM deduped WHERE rn > 1) AS duplicates_removed, (SELECT {s.count()} FROM prepared) AS after_short_filter,
  (SELECT {s.count()} FROM prepared) AS "final" """))
def a16(spark, sf_dir):
    return preparation.funnel(preparation.raw_conversations(st.tweets(spark, sf_dir)))


# ------------------------------------------------------------------ contracts


def _messages_as_conversations(spark, sf_dir):
    """Every message as a conversation row, with nulls, blanks and repeated ids."""
    tid = F.col("tweet_id")
    return st.tweets(spark, sf_dir).select(
        F.when(tid % 37 != 0, (tid / 2).cast("bigint").cast("string")).alias("conversation_id"),
        threads.tx.extract_mention(F.col("text")).alias("brand"),
        F.when(tid % 10 != 0, threads.tx.clean_text(F.col("text"))).otherwise("").alias("customer_message"),
        F.col("response_tweet_id").alias("historical_support_response"),
        F.col("created_at").alias("timestamp"),
        F.length("text").alias("conversation_length"),
        F.col("inbound").cast("string").alias("is_escalation"),
    )


_AS_CONV = f"""c AS (
  SELECT CASE WHEN tweet_id % 37 <> 0 THEN CAST(tweet_id // 2 AS VARCHAR) END AS conversation_id, {s.mention(s.strip('text'))} AS brand,
    CASE WHEN tweet_id % 10 <> 0 THEN {s.clean('text')} ELSE '' END AS customer_message, response_tweet_id AS historical_support_response,
    created_at AS "timestamp", length(text) AS conversation_length FROM tweets
), t AS (SELECT count(*) AS total FROM c)"""


def _nulls_sql(col: str, error: float, warn: float) -> str:
    return f"""SELECT CASE WHEN n * 100.0::DOUBLE / total > {error} THEN 'error' ELSE 'warning' END AS severity, 'nulls' AS "check", '{col}' AS "column", n,
      {s.r6('n * 100.0::DOUBLE / total')} AS value FROM (SELECT {s.count()} AS n FROM c WHERE "{col}" IS NULL), t WHERE n * 100.0::DOUBLE / total > {warn}"""


def _info_sql(severity: str, check: str, col: str | None, n: str, value: str = "NULL", where: str = "true") -> str:
    column = "CAST(NULL AS VARCHAR)" if col is None else f"'{col}'"
    return f"""SELECT '{severity}', '{check}', {column}, CAST({n} AS BIGINT), {s.r6(value)} FROM c HAVING {where}"""


_CRITICAL = ("conversation_id", "brand", "customer_message", "historical_support_response")
_A_SQL = " UNION ALL ".join(
    [_nulls_sql(c, 5, 0) for c in _CRITICAL]
    + [_info_sql("error", "missing_column", c, "1") for c in ("conversation_context", "customer_author", "support_author")]
    + [_info_sql("info", "rows", None, "count(*)")]
    + [_info_sql("warning", "blanks", c, f"count_if({c} = '')", where=f"count_if({c} = '') > 0") for c in _CRITICAL]
    + [
        _info_sql("info", "mean_length", "conversation_length", "NULL", "avg(conversation_length)"),
        _info_sql("info", "max_length", "conversation_length", "max(conversation_length)"),
        _info_sql("info", "mean_chars", "customer_message", "NULL", "avg(length(customer_message))"),
        _info_sql("warning", "duplicates", "conversation_id",
                  "count(*) - count(DISTINCT conversation_id) - max(CASE WHEN conversation_id IS NULL THEN 1 ELSE 0 END)"),
        _info_sql("info", "brands", "brand", "count(DISTINCT brand)"),
    ]
)
_B_SQL = " UNION ALL ".join(
    [_nulls_sql(c, 50, 5) for c in (*_CRITICAL, "timestamp")]
    + [_info_sql("info", "rows", None, "count(*)"), _info_sql("warning", "wrong_type", "is_escalation", "1")]
    + [_info_sql("info", "optional_present", c, "1") for c in ("conversation_length", "is_escalation")]
)


@query("a12_contract_a", s.with_(s.TWEETS, _AS_CONV, body=_A_SQL))
def a12(spark, sf_dir):
    return contract.check(_messages_as_conversations(spark, sf_dir), contract.CONTRACT_A)


@query("a13_contract_b", s.with_(s.TWEETS, _AS_CONV, body=_B_SQL))
def a13(spark, sf_dir):
    return contract.check(_messages_as_conversations(spark, sf_dir), contract.CONTRACT_B)


@query("u3_missing_columns", s.with_(s.TWEETS, _AS_CONV, body=f"""
SELECT unnest(['conversation_context', 'customer_author', 'support_author']) AS "column", n FROM (SELECT {s.count()} AS n FROM c)"""))
def u3(spark, sf_dir):
    return contract.missing_cells(_messages_as_conversations(spark, sf_dir), contract.CONTRACT_A)


@query("a12_contract_on_prepared", s.with_(*s.ALL_CONVERSATIONS, body=f"""
SELECT count_if(conversation_id IS NULL OR brand IS NULL OR customer_message IS NULL OR historical_support_response IS NULL) = 0 AS valid FROM prepared"""))
def a12_valid(spark, sf_dir):
    return contract.is_valid(contract.check(preparation.prepare(st.tweets(spark, sf_dir)), contract.CONTRACT_A))


@query("a14_contract_violations", s.with_(s.TWEETS, _AS_CONV, body="""
SELECT conversation_id FROM c WHERE customer_message IS NULL OR historical_support_response IS NULL OR brand IS NULL"""))
def a14(spark, sf_dir):
    return contract.violations(_messages_as_conversations(spark, sf_dir))


# ------------------------------------------------------------- split and leakage

SPLIT = f"""
ordered AS (SELECT doc_id, text, lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
  count(*) OVER (PARTITION BY lang) AS n FROM documents),
split AS (SELECT doc_id, text, lang, source, rn <= round(n * 0.2::DOUBLE) AS is_test FROM ordered)
"""


@query("w12_stratified_split", s.with_(SPLIT, body="SELECT doc_id, lang, is_test FROM split"))
def w12(spark, sf_dir):
    return intents.stratified_split(st.documents(spark, sf_dir), "doc_id", "lang").select("doc_id", "lang", "is_test")


def _sides(spark, sf_dir):
    split = intents.stratified_split(st.strata(spark, sf_dir), "conversation_id", "intent")
    return split.filter(~F.col("is_test")), split.filter("is_test")


def _leak_sql(name: str, col: str, rule: str) -> str:
    both = f"(SELECT {col} FROM split WHERE NOT is_test INTERSECT SELECT {col} FROM split WHERE is_test)"
    return f"""SELECT *, {rule} AS leak FROM (SELECT '{name}' AS "column", (SELECT {s.count()} FROM {both}) AS overlap,
      (SELECT {s.count(f'DISTINCT {col}')} FROM split WHERE is_test) AS test_distinct,
      round((SELECT count(*) FROM {both}) * 100.0::DOUBLE / (SELECT count(DISTINCT {col}) FROM split WHERE is_test), 6) AS pct)"""


@query("j9_leakage", s.with_(SPLIT, body=" UNION ALL ".join((
    _leak_sql("conversation_id", "doc_id", "overlap > 0"), _leak_sql("customer_message", "text", "pct > 1"),
    _leak_sql("customer_author", "source", "false")))))
def j9(spark, sf_dir):
    return contract.leakage(*_sides(spark, sf_dir))


@query("u2_common_messages", s.with_(SPLIT, body="""
SELECT text AS customer_message FROM split WHERE NOT is_test INTERSECT SELECT text FROM split WHERE is_test"""))
def u2(spark, sf_dir):
    return contract.common_values(*_sides(spark, sf_dir), "customer_message")


@query("j7_attach_labels", """
SELECT d.doc_id AS conversation_id, d.lang AS intent, l.quality, l.toxic FROM (SELECT doc_id, lang FROM documents) d LEFT JOIN
  (SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels) l ON d.doc_id = l.doc_id""")
def j7(spark, sf_dir):
    labels = st.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conversation_id"), "quality", "toxic")
    return golden.attach_labels(st.strata(spark, sf_dir).select("conversation_id", "intent"), labels)
