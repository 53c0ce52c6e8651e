"""Registered queries against their SQL twins, and the shape of their plans."""

import ast
import math
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from threadloom.plans import preparation

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# trained models and searches: tested on their own
LEARNED = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    cols = sorted(df.columns)
    ours = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_the_rest_works_without_the_training_data_folders(tmp_path):
    """A copy without both folders and the pipeline imports and lists all other queries."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "threadloom", tmp_path / "threadloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    show = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()), sep=chr(10))"
    out = subprocess.run([sys.executable, "-c", show], cwd=tmp_path, capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    queries, oracles = (ast.literal_eval(line) for line in out.stdout.splitlines())
    ours = lambda names: sorted(n for n in names if n != "pipeline" and not n.startswith("op"))
    assert queries == ours(QUERIES) and oracles == ours(ORACLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "conversation_context" in df.columns


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(ORACLES) if n[:2] in ("p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9", "d1", "d4", "d6", "j1", "j2", "j3", "j4", "w1", "w2", "a9", "j6")])
def test_no_cross_join_and_no_python(spark, data_dir, name):
    # block products run in Python, in these searches alone
    search = name in ("j11_candidate_pool", "j11_blocked_grid", "j12_evidence_gate", "j17_similar_by_terms", "d10_quick_evaluation", "p24_prompts")
    text = plan(QUERIES[name](spark, data_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin") + (() if search else ("Python", "InPandas")):
        assert bad not in text


def test_preparation_reads_texts_once_after_the_id_table(spark, tmp_path):
    rows = [(1, "u", True, "@acme help me now please", None, "2"), (2, "acme", False, "@u we are on it now", 1, None)]
    spark.createDataFrame(rows, "tweet_id bigint, author_id string, inbound boolean, text string, in_response_to_tweet_id bigint, response_tweet_id string").withColumn(
        "created_at", F.lit("Wed Oct 11 06:55:44 +0000 2017")).write.parquet(str(tmp_path / "t"))
    prepared = preparation.prepare(spark.read.parquet(str(tmp_path / "t")))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", prepared._jdf.queryExecution().optimizedPlan().toString() + plan(prepared))
    assert sum("text:string" in x for x in scans) == 1 and prepared.count() == 1


def test_dedup_limits_rows_before_the_shuffle(spark, data_dir):
    assert plan(QUERIES["w1_dedup_messages"](spark, data_dir)).count("WindowGroupLimit") == 2
