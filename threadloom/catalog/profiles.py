"""Queries profiling the message table and ranking brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BrandScoreSettings
from ..operators import audit
from ..plans import audit as audit_job
from ..sources import standins as st, tables
from . import sql as s
from .registry import query

_TYPES = {
    "tweet_id": "bigint", "author_id": "string", "inbound": "boolean", "created_at": "string", "text": "string",
    "response_tweet_id": "string", "in_response_to_tweet_id": "bigint",
}


@query("s7_reproducible_sample", """
SELECT doc_id, text FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 500""")
def s7(spark, sf_dir):
    return tables.sample_table(st.documents(spark, sf_dir).select("doc_id", "text"), "doc_id", 500)


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS \"type\", {s.count()} - {s.count(c)} AS nulls, {s.pct2(f'(count(*) - count({c}))', 'count(*)')} AS null_pct, {s.count()} AS \"rows\" FROM tweets"
    for c, t in _TYPES.items()
)


@query("a1_table_profile", s.with_(s.TWEETS, body=_PROFILE))
def a1(spark, sf_dir):
    return audit.profile(st.tweets(spark, sf_dir))


@query("a2_duplicates", s.with_(s.TWEETS, """
twice AS (SELECT author_id, inbound, text FROM tweets)""", body=f"""
SELECT 'rows' AS kind, {s.count()} - (SELECT {s.count()} FROM (SELECT DISTINCT * FROM twice)) AS n FROM twice
UNION ALL SELECT 'author_id', {s.count()} - {s.count('DISTINCT author_id')} FROM twice"""))
def a2(spark, sf_dir):
    return audit.duplicates(st.tweets(spark, sf_dir).select("author_id", "inbound", "text"), "author_id")


@query("a3_directions", s.with_(s.TWEETS, body=f"""
SELECT CAST(count_if(inbound) AS BIGINT) AS inbound, CAST(count_if(NOT inbound) AS BIGINT) AS outbound,
  {s.pct2('count_if(inbound)', 'count(inbound)')} AS inbound_pct, {s.pct2('count_if(NOT inbound)', 'count(inbound)')} AS outbound_pct FROM tweets"""))
def a3(spark, sf_dir):
    return audit.directions(st.tweets(spark, sf_dir))


@query("a4_authors", s.with_(s.TWEETS, body=f"SELECT {s.count('DISTINCT author_id')} AS authors FROM tweets"))
def a4(spark, sf_dir):
    return audit.authors(st.tweets(spark, sf_dir))


_AT = "try_strptime(substr(created_at, 5), '%b %d %H:%M:%S +0000 %Y')"


@query("a5_date_range", s.with_(s.TWEETS, f"dated AS (SELECT created_at, {_AT} AS seen FROM tweets)", body=f"""
SELECT strftime(min(seen), '%Y-%m-%d %H:%M:%S') AS "first", strftime(max(seen), '%Y-%m-%d %H:%M:%S') AS "last",
  CAST(floor(date_diff('second', min(seen), max(seen)) / 86400.0) AS BIGINT) AS span_days,
  CAST(count_if(seen IS NULL AND created_at IS NOT NULL) AS BIGINT) AS unparsable FROM dated"""))
def a5(spark, sf_dir):
    text = "yyyy-MM-dd HH:mm:ss"
    return audit.date_range(st.tweets(spark, sf_dir)).select(
        F.date_format("first", text).alias("first"), F.date_format("last", text).alias("last"), "span_days", "unparsable"
    )


_LENGTHS = ", ".join(
    f"{(s.r6(f'{fn}({c})') if fn in ('avg', 'median') else f'{fn}({c})')} AS {n}_{c}"
    for c in ("chars", "words") for n, fn in (("min", "min"), ("max", "max"), ("mean", "avg"), ("median", "median"))
)


@query("a6_text_statistics", s.with_(s.TWEETS, f"l AS (SELECT length(text) AS chars, CAST({s.n_words('text')} AS BIGINT) AS words FROM tweets)", body=f"""
SELECT {_LENGTHS}, CAST(count_if(chars IS NULL) AS BIGINT) AS empty FROM l"""))
def a6(spark, sf_dir):
    return audit.text_statistics(st.tweets(spark, sf_dir))


@query("a6_document_statistics", f"""
SELECT {_LENGTHS}, CAST(count_if(chars IS NULL) AS BIGINT) AS empty FROM (SELECT length(text) AS chars, CAST({s.n_words('text')} AS BIGINT) AS words FROM documents)""")
def a6_documents(spark, sf_dir):
    return audit.text_statistics(st.documents(spark, sf_dir))


@query("a7_link_presence", s.with_(s.TWEETS, body=f"""
SELECT {s.count('response_tweet_id')} AS with_replies, {s.count('in_response_to_tweet_id')} AS with_parent,
  {s.pct2('count(response_tweet_id)', 'count(*)')} AS with_replies_pct, {s.pct2('count(in_response_to_tweet_id)', 'count(*)')} AS with_parent_pct FROM tweets"""))
def a7(spark, sf_dir):
    return audit.link_presence(st.tweets(spark, sf_dir))


@query("j6_link_validity", s.with_(s.TWEETS, """
links AS (
  SELECT 'reply' AS kind, TRY_CAST(unnest(string_split(response_tweet_id, ',')) AS BIGINT) AS target FROM tweets
  UNION ALL SELECT 'parent', in_response_to_tweet_id FROM tweets WHERE in_response_to_tweet_id IS NOT NULL
)""", body=f"""
SELECT kind, {s.count()} AS links, CAST(count_if(target IN (SELECT tweet_id FROM tweets)) AS BIGINT) AS valid,
  CAST(count_if(target NOT IN (SELECT tweet_id FROM tweets)) AS BIGINT) AS broken FROM links GROUP BY kind"""))
def j6(spark, sf_dir):
    return audit.link_validity(st.tweets(spark, sf_dir))


_VOLUMES = f"""
outb AS (SELECT lower(author_id) AS brand, {s.count()} AS outbound FROM tweets WHERE NOT inbound GROUP BY 1),
inb AS (SELECT {s.mention('text')} AS brand, {s.count()} AS inbound FROM tweets WHERE inbound GROUP BY 1),
volumes AS (SELECT o.brand, outbound, coalesce(i.inbound, 0) AS inbound, outbound + coalesce(i.inbound, 0) AS total FROM outb o LEFT JOIN inb i ON o.brand = i.brand)"""


@query("j13_brand_volumes", s.with_(s.TWEETS, _VOLUMES, body="SELECT * FROM volumes"))
def j13(spark, sf_dir):
    return audit.brand_volumes(st.tweets(spark, sf_dir))


@query("a8_top_brands", s.with_(s.TWEETS, _VOLUMES, body="SELECT * FROM volumes ORDER BY total DESC, brand LIMIT 30"))
def a8(spark, sf_dir):
    return audit.top_brands(st.tweets(spark, sf_dir))


@query("w7_top_three_brands", s.with_(s.TWEETS, _VOLUMES, body="SELECT * FROM volumes ORDER BY total DESC, brand LIMIT 3"))
def w7(spark, sf_dir):
    return audit.top_brands(st.tweets(spark, sf_dir), 3)


@query("a8_support_accounts", s.with_(s.TWEETS, _VOLUMES, body=f"SELECT {s.count()} AS accounts FROM volumes"))
def a8_accounts(spark, sf_dir):
    return audit.brand_volumes(st.tweets(spark, sf_dir)).agg(F.count("*").alias("accounts"))


_SETTINGS = BrandScoreSettings(min_outbound=5, min_inbound=5)
_OPENING = r"array_to_string(regexp_split_to_array(" + s.strip(f"regexp_replace(text, '^@{s.NAME}{s.SPACE}*', '')") + f", '{s.SPACE}+')[1:3], ' ')"


@query("a9_brand_scores", s.with_(s.TWEETS, _VOLUMES, f"""
named AS (SELECT *, {s.mention('text')} AS target, lower(author_id) AS author_lower FROM tweets),
touch AS (
  SELECT v.brand, count(*) AS n_all, count(in_response_to_tweet_id) AS with_parent,
    count_if(t.inbound AND t.target = v.brand AND t.response_tweet_id IS NOT NULL) AS answered
  FROM volumes v JOIN named t ON t.author_lower = v.brand OR t.target = v.brand GROUP BY v.brand
),
openings AS (
  SELECT target AS brand, {_OPENING} AS opening FROM named WHERE inbound AND target IS NOT NULL
),
diversity AS (SELECT brand, count(DISTINCT opening)::DOUBLE / count(*) AS d FROM openings GROUP BY brand),
parts AS (
  SELECT v.brand, v.outbound AS o, v.inbound AS i, t.answered::DOUBLE / v.inbound AS completeness, t.with_parent::DOUBLE / t.n_all AS parents, d.d,
    v.inbound::DOUBLE / v.outbound AS ratio
  FROM volumes v JOIN touch t ON t.brand = v.brand JOIN diversity d ON d.brand = v.brand WHERE v.outbound >= 5 AND v.inbound >= 5
)""", body="""
SELECT brand, o AS n_outbound, i AS n_inbound, round(completeness, 4) AS conversation_completeness, round(parents, 4) AS parent_link_ratio,
  round(d, 4) AS text_diversity, round(ratio, 4) AS inbound_outbound_ratio,
  round(0.15::DOUBLE * least(o / 10000.0::DOUBLE, 1) + 0.15::DOUBLE * least(i / 10000.0::DOUBLE, 1) + 0.25::DOUBLE * completeness
    + 0.20::DOUBLE * least(d, 1) + 0.15::DOUBLE * least(ratio, 1.5::DOUBLE) / 1.5::DOUBLE + 0.10::DOUBLE * parents, 4) AS composite_score
FROM parts"""))
def a9(spark, sf_dir):
    return audit.brand_scores(st.tweets(spark, sf_dir), _SETTINGS)


def _v(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


_REPORT = f"""
l AS (SELECT length(text) AS chars, {s.n_words('text')} AS words, {_AT} AS seen, * FROM tweets),
replies AS (SELECT TRY_CAST(unnest(string_split(response_tweet_id, ',')) AS BIGINT) AS target FROM tweets)"""
_LINES = (
    [("nulls", c, f"count(*) - count({c})") for c in _TYPES]
    + [("duplicates", "rows", "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tweets))"),
       ("duplicates", "tweet_id", "count(*) - count(DISTINCT tweet_id)"),
       ("valid_links", "reply", "max((SELECT count(*) FROM replies WHERE target IN (SELECT tweet_id FROM tweets)))"),
       ("valid_links", "parent", "count_if(in_response_to_tweet_id IN (SELECT tweet_id FROM tweets))"),
       ("directions", "inbound", "count_if(inbound)"), ("directions", "outbound", "count_if(NOT inbound)"),
       ("directions", "inbound_pct", s.pct2("count_if(inbound)", "count(inbound)")),
       ("directions", "outbound_pct", s.pct2("count_if(NOT inbound)", "count(inbound)")),
       ("authors", "authors", "count(DISTINCT author_id)"),
       ("dates", "span_days", "CAST(floor(date_diff('second', min(seen), max(seen)) / 86400.0) AS BIGINT)"),
       ("dates", "unparsable", "count_if(seen IS NULL AND created_at IS NOT NULL)"),
       ("texts", "min_chars", "min(chars)"), ("texts", "max_chars", "max(chars)"), ("texts", "min_words", "min(words)"),
       ("texts", "max_words", "max(words)"), ("texts", "empty", "count_if(chars IS NULL)"),
       ("links", "with_replies", "count(response_tweet_id)"), ("links", "with_parent", "count(in_response_to_tweet_id)"),
       ("links", "with_replies_pct", s.pct2("count(response_tweet_id)", "count(*)")),
       ("links", "with_parent_pct", s.pct2("count(in_response_to_tweet_id)", "count(*)"))]
)


@query("d7_audit_report", s.with_(s.TWEETS, _REPORT, body=" UNION ALL ".join(
    f"SELECT '{sec}' AS section, '{item}' AS item, {_v(expr)} AS value FROM l" for sec, item, expr in _LINES)))
def d7(spark, sf_dir):
    return audit_job.report(st.tweets(spark, sf_dir))
