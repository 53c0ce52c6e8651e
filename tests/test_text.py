import pytest
from pyspark.sql import functions as F

from threadloom.functions import judgement, parsing, rules, text as tx


def value(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).cast("string" if v is None else "string" if isinstance(v, str) else "double").alias(k) for k, v in cols.items()])
    return row.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [
    ("@brand hello world", "hello world"), ("@brand check https://example.com", "check [URL]"), (None, ""),
    ("  @Brand \n two\t lines \n", "two lines"), ("mid @brand stays", "mid @brand stays"),
    ("@Café help me please\u00a0", "help me please"), ("\u2003@Ünal\u00a0 hi\x1cthere https://a.b/c\u00a0x", "hi there [URL] x"),
])
def test_clean_text(spark, text, want):
    assert value(spark, tx.clean_text(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("@acme help me", "acme"), ("hello world", None), (None, None), (" @X y", "x"), ("@Café help", "café"), ("\u00a0@日本_1 x", "日本_1")])
def test_extract_mention(spark, text, want):
    assert value(spark, tx.extract_mention(F.col("t")), t=text) == want


def test_words_are_parted_by_every_blank(spark):
    assert value(spark, tx.word_count(F.col("t")), t=" a\u00a0b\u2003c\x1fd ") == 4
    assert value(spark, tx.opening_words(F.col("t")), t="@Café un\u00a0deux trois quatre") == "un deux trois"


def test_blanks_kept_variant_is_ascii(spark):
    assert value(spark, tx.clean_text(F.col("t"), collapse=False), t="@Café  x") == "é  x"


def test_mention_without_strip(spark):
    assert value(spark, tx.extract_mention(F.col("t"), strip_first=False), t=" @x y") is None


@pytest.mark.parametrize("text,want", [
    ("1,2,3", 3), ("7", 7), ("119236.0", 119236), ("5,bad", 5), ("bad", None), ("", None), (None, None), (" 4 , 9 ", 9),
    ("9007199254740993", 9007199254740993),
])
def test_last_id(spark, text, want):
    assert value(spark, tx.last_id(F.col("t")), t=text) == want


def test_conversation_length_counts_separators(spark):
    assert value(spark, tx.conversation_length(F.col("t")), t="") == 2
    assert value(spark, tx.conversation_length(F.col("t")), t="[customer]: a | [support]: b") == 4
    assert value(spark, tx.conversation_length(F.col("t")), t="[customer]: a | inside") == 4


def test_created_at(spark):
    got = value(spark, F.date_format(tx.parse_created_at(F.col("t")), "yyyy-MM-dd HH:mm:ss"), t="Wed Oct 11 06:55:44 +0000 2017")
    assert got == "2017-10-11 06:55:44"
    assert value(spark, tx.parse_created_at(F.col("t")), t="bad date") is None


def test_context_prefix_takes_the_tail(spark):
    assert value(spark, tx.with_context(F.col("c"), F.col("m")), c="x" * 300, m="hi") == "x" * 200 + " hi"
    assert value(spark, tx.with_context(F.col("c"), F.col("m")), c="  ", m="hi") == "hi"
    assert value(spark, tx.with_context(F.col("c"), F.col("m")), c=None, m="hi") == "hi"


@pytest.mark.parametrize("text", [
    "can you connect me with a human", "I want to talk to a person", "speak to someone please", "human agent now",
    "I don't want a bot", "live agent", "transfer me", "customer service rep",
])
def test_human_request(spark, text):
    assert value(spark, judgement.asks_for_human(F.col("t")), t=text) is True


def test_no_human_request(spark):
    assert value(spark, judgement.asks_for_human(F.col("t")), t="How do I change my plan?") is False
    assert value(spark, judgement.asks_for_human(F.col("t")), t=None) is False


def test_sensitive_words_are_substrings_in_list_order(spark):
    assert value(spark, judgement.sensitive_found(F.col("t")), t="My issue is solved") == ["sue"]
    assert value(spark, judgement.sensitive_found(F.col("t")), t="police, fraud, lawyer") == ["lawyer", "fraud", "police"]


@pytest.mark.parametrize("text,want", [
    ("I checked your account and", False), ("I have fixed this for you", False), ("I escalated this to them", False),
    ("I can see your account is", False), ("Try logging out and logging back in.", True),
])
def test_grounding(spark, text, want):
    assert value(spark, judgement.is_grounded(F.col("t")), t=text) is want


def test_cluster_name_ties_take_the_first(spark):
    named = lambda *t: spark.range(1).select(judgement.name_cluster(F.array(*[F.lit(x) for x in t])).alias("v")).first()["v"]
    assert named("zzz") == rules.DEFAULT_INTENT
    assert named("login", "song") == "account_access"
    assert named("song", "music", "login") == "playback_issues"


def test_difficulty_order(spark):
    got = lambda t: value(spark, judgement.difficulty(F.col("t")), t=t)
    assert got("refund") == "easy"
    assert got("x" * 201) == "hard"
    assert got("why do you cancel my subscription every single month?") == "medium"
    assert got("please cancel my subscription for the next month, all") == "hard"
    assert got("nothing special happens in this message of fifty chars") == "medium"


def test_override_needs_the_class(spark):
    cols = dict(i="other", c=0.9, ctx="your login", m="me@mail")
    f = lambda classes: value(spark, judgement.account_override(F.col("i"), F.col("c"), F.col("ctx"), F.col("m"), classes)[0], **cols)
    assert f(["account_access", "other"]) == "account_access"
    assert f(["other"]) == "other"


@pytest.mark.parametrize("text,reply,escalate", [
    ('{"reply": " ok ", "needs_escalation": false}', "ok", False),
    ('```json\n{"reply": "a", "needs_escalation": true}\n```', "a", True),
    ("```\n{\"reply\": \"b\"}\n```", "b", False),
    ("", rules.EMPTY_DRAFT[0], True), (None, rules.EMPTY_DRAFT[0], True),
    ("not json", rules.UNPARSABLE_DRAFT[0], True), ("[1, 2]", rules.UNPARSABLE_DRAFT[0], True),
])
def test_parse_draft(spark, text, reply, escalate):
    got = value(spark, parsing.parse_draft(F.col("t")), t=text)
    assert (got["reply"], got["escalate"]) == (reply, escalate)


@pytest.mark.parametrize("text,want", [
    ('{"safety": {"score": 4}}', 4.0), ('{"safety": 3.7}', 3.0), ('{"safety": "4"}', None), ('{"safety": {"note": 1}}', None), ("{}", None),
])
def test_extract_score(spark, text, want):
    assert value(spark, parsing.extract_score(F.try_parse_json(F.col("t")), "safety"), t=text) == want


def test_unreadable_rating_gives_threes(spark):
    got = value(spark, parsing.parse_judge(F.col("t")), t="sorry")
    assert got == {d: 3.0 for d in rules.DIMENSIONS}
    assert value(spark, parsing.judge_overall(F.col("t")), t="sorry") is None
    assert value(spark, parsing.judge_overall(F.col("t")), t='{"overall_score": 4}') == 4.0
