import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import simhash as s
from threadloom.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints):
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for i, g in zip(ids, group):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return [least[g] for g in group]


def test_spark_hash_is_the_stated_one(spark):
    assert spark.sql("select xxhash64('a b c') h").first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_odd_documents(odd_docs):
    rows = odd_docs.collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], prints, slow_components([r.doc_id for r in rows], prints)), key=str)
    found = sorted(((r.id, r.fp % 2**64, r.component) for r in s.cluster(odd_docs).collect()), key=str)
    assert found == want


@pytest.mark.parametrize("hot", [256, 4, 0])
def test_links_lose_nothing_in_crowded_segments(spark, hot):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    prints = set(base)
    for b in base:  # families that share segments, chains of two bits
        for _ in range(40):
            b ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            prints |= {b, b ^ 1 << int(rng.integers(64))}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.node: r.root for r in components(s.links(table, hot)).collect()}
    want = slow_components(signed, prints)
    assert [found.get(p, p) for p in signed] == want


def test_one_of_each_group_stays(odd_docs, no_docs):
    kept = s.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.text and "quick" in r.text.lower()) == [1]
    blank = [r for r in kept.collect() if not (r.text or "").strip()]
    assert [r.doc_id for r in blank] == [3]
    assert s.keep_one(no_docs).count() == 0 and s.cluster(no_docs).count() == 0


def test_long_chain_and_star(spark):
    links = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(300, 500).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b")))
    roots = {r.node: r.root for r in components(links).collect()}
    assert roots == {i: 0 for i in range(201)} | {i: 300 for i in range(300, 500)} | {1000: 300}
    assert components(links.limit(0)).count() == 0


def test_settled_links_are_written_once(spark, monkeypatch):
    from threadloom.llm import components as c

    names = []
    monkeypatch.setattr(c, "stage", lambda df, name, f=c.stage: names.append(name) or f(df, name))
    stars = spark.range(1, 100).select(F.col("id").alias("a"), (F.col("id") * 0).alias("b")).union(spark.createDataFrame([(201, 200)], "a long, b long"))
    assert {r.node: r.root for r in c.components(stars).collect()} == {i: 0 for i in range(100)} | {200: 200, 201: 200}
    assert names == ["links"]
