import pytest
from pyspark.sql import functions as F

from threadloom.operators import threads
from threadloom.plans import preparation
from threadloom.sources import tables, tweets as raw

SCHEMA = raw.TWEET_SCHEMA
D = "Wed Oct 11 06:55:44 +0000 2017"


def make(spark, rows):
    """rows: (id, author, inbound, text, replies, parent)."""
    data = [(i, a, inb, D, t, r, None if p is None else float(p)) for i, a, inb, t, r, p in rows]
    df = spark.createDataFrame(data, SCHEMA)
    return df.withColumn("in_response_to_tweet_id", F.col("in_response_to_tweet_id").cast("bigint"))


def pairs(df, **kw):
    got = threads.pair_replies(threads.brand_slice(df), **kw).collect()
    return sorted((r["tweet_id"], r["response_id"], r["by_reply_id"]) for r in got)


@pytest.fixture(scope="module")
def thread(spark):
    return make(spark, [
        (1, "u1", True, "@Acme my song does not play", "2,9", None),        # last id 9 is unknown, child 2 answers
        (2, "Acme", False, "@u1 please try again, ok?", "3", 1),
        (3, "u1", True, "@acme still broken | really", "5,4", 2),            # last id 4 wins
        (4, "Acme", False, "@u1 let us check that", None, 3),
        (5, "Acme", False, "@u1 another answer here", None, 3),
        (6, "u2", True, "@acme hello out there", "0", None),                 # id 0 is missing, no child
        (7, "u3", True, "@other talk to me", "4", None),                     # reply of another brand
        (8, "u4", True, "@acme two children here", None, 99),                # parent missing
        (11, "Acme", False, "@u4 later answer", None, 8),
        (10, "Acme", False, "@u4 first answer", None, 8),
        (12, "u5", True, None, "4", None),
    ])


def test_pairs_follow_both_links(thread):
    assert pairs(thread) == [(1, 2, False), (3, 4, True), (8, 10, False)]


def test_first_id_variant(thread):
    assert pairs(thread, pick="first") == [(1, 2, True), (3, 5, True), (8, 10, False)]


def test_single_methods_agree_with_the_combined_one(thread):
    sliced = threads.brand_slice(thread)
    one = {(r["tweet_id"], r["response_id"]) for r in threads.pairs_by_reply_id(sliced).collect()}
    two = {(r["tweet_id"], r["response_id"]) for r in threads.pairs_by_parent(sliced).collect()}
    assert one == {(3, 4)} and two == {(1, 2), (8, 10)}


def test_context_runs_oldest_first_and_stops_at_gaps(thread):
    rows = {r["customer_tweet_id"]: r for r in preparation.raw_conversations(thread).collect()}
    assert rows[3]["conversation_context"] == "[customer]: my song does not play | [support]: please try again, ok?"
    assert rows[3]["conversation_length"] == 4
    assert rows[8]["conversation_context"] == "" and rows[8]["conversation_length"] == 2
    assert rows[1]["parent_tweet_id"] is None and rows[8]["parent_tweet_id"] == "99"


def test_context_depth(spark):
    chain = [(1, "u", True, "@acme one", None, None)]
    chain += [(i, "u", True, f"@acme line {i}", None, i - 1) for i in range(2, 7)] + [(7, "Acme", False, "@u answer", None, 6)]
    row = preparation.raw_conversations(make(spark, chain)).first()
    assert row["conversation_context"].split(" | ") == [f"[customer]: line {i}" for i in (3, 4, 5)]


def test_a_parent_shared_by_many(spark):
    rows = [(1, "Acme", False, "@all news for you", None, None)]
    rows += [(i, f"u{i}", True, f"@acme reply number {i}", None, 1) for i in range(2, 402)]
    rows += [(i + 1000, "Acme", False, "@u thanks for that", None, i) for i in range(2, 402)]
    out = preparation.prepare(make(spark, rows))
    assert out.count() == 400
    assert out.filter(F.col("conversation_context") == "[support]: news for you").count() == 400


def test_copied_messages_keep_the_first(spark):
    rows = [(i, f"u{i}", True, "@acme the same words again", None, None) for i in range(1, 301)]
    rows += [(i + 1000, "Acme", False, "@u thanks for that", None, i) for i in range(1, 301)]
    out = preparation.prepare(make(spark, rows)).collect()
    assert [r["customer_author"] for r in out] == ["u1"]
    funnel = preparation.funnel(preparation.raw_conversations(make(spark, rows))).first()
    assert (funnel["initial"], funnel["duplicates_removed"], funnel["final"]) == (300, 299, 1)


def test_run_writes_and_checks(spark, thread, tmp_path):
    found = preparation.run(thread, str(tmp_path), fail=True)
    assert found.filter("severity = 'error'").count() == 0
    back = spark.read.parquet(f"{tmp_path}/conversations")
    assert back.count() == preparation.prepare(thread).count()
    assert tables.read_csv(spark, f"{tmp_path}/sample", back.schema).count() == back.count()


def test_an_empty_result_fails_the_contract(spark, tmp_path):
    empty = make(spark, [(1, "u", True, "no brand here", None, None)])
    with pytest.raises(ValueError):
        preparation.run(empty, str(tmp_path), fail=True)
