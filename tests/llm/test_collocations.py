import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.llm import collocations as c


def slow(rows, min_count=10, top=2000, longest=3):
    """All phrases of every language in one counter each."""
    counts = {}
    for lang, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            own.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        n = sum(f for p, f in own.items() if len(p) == 1)
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts(seed, rows, vocabulary, longest=60):
    rng = random.Random(seed)
    words = [f"{'W' if i % 5 == 0 else 'w'}{i}" for i in range(vocabulary)] + ["é", "日本", "x\x1cy"]
    phrases = [" ".join(rng.choices(words, k=rng.randint(2, 4))) for _ in range(30)]
    made = []
    for _ in range(rows):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, longest))]
        made.append((rng.choice(["en", "de", None, "und", ""]), "".join(p + rng.choice([" ", " ", "\t", ". ", ",", "\r\n", "  "]) for p in parts)))
    return made


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("burst,entries", [(c.BURST, c.ENTRIES), (3, 40)])
def test_as_by_brute_force(spark, burst, entries):
    rows = texts(1, 400, 60) + [("en", None), (None, "One Two three " * 15), ("fr", "a b c " * 9), ("fr", "")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    found = c.collocations(docs, burst=burst, entries=entries).select(COLUMNS).collect()
    assert sorted(tuple(r) for r in found) == slow(rows)


def test_other_settings(spark):
    rows = texts(2, 200, 25)
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = c.collocations(docs, min_count=4, max_words=2, top=7).select(COLUMNS).collect()
    assert sorted(tuple(r) for r in found) == slow(rows, 4, 7, 2)
    with pytest.raises(ValueError):
        c.collocations(docs, max_words=4)


def test_a_small_filter_loses_nothing(spark, monkeypatch):
    rows = texts(3, 200, 200)
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(c.Filter, "of_size", classmethod(lambda cls, phrases, bits_each=0, at_most=0: cls(c.np.zeros(4, c.np.uint8))))
    found = c.collocations(docs).select(COLUMNS).collect()
    assert sorted(tuple(r) for r in found) == slow(rows)


def test_the_filter_drops_most_others():
    known = c.Filter.of_size(1000)
    rng = c.np.random.default_rng(1)
    inside, other = rng.integers(0, 2**63, 1000).astype(c.np.uint64), rng.integers(0, 2**63, 100_000).astype(c.np.uint64)
    byte, bit = known.places(inside)
    c.np.bitwise_or.at(known.bits, byte, bit)
    assert known.has(inside).all() and known.has(other).mean() < 0.05


def test_a_trie_bursts_and_spills_its_largest_subtrees():
    number = lambda p: p[0] << 2 * c.WORD_BITS | p[1] << c.WORD_BITS | p[2]
    trie = c.Trie(3, burst=4)
    phrases = Counter([(1, i % 3, i) for i in range(12)] + [(2, 1, 1)] * 5 + [(3, 1, 1)])
    for part in (list(phrases)[:3], list(phrases)[3:9], list(phrases)[9:], [(1, 0, 0), (1, 5, 5)]):
        part = sorted(part)
        trie.add(c.np.array([number(p) for p in part]), c.np.array([phrases.get(p, 1) for p in part]))
    assert trie.size == 15 and trie.root[1][2] and not trie.root[2][2]
    first = [x for keys, counts in trie.spill(2) for x in zip(keys.tolist(), counts.tolist())]
    assert trie.size == 2 and dict(first) == {number(p): 1 + (p == (1, 0, 0)) for p in [*phrases, (1, 5, 5)] if p[0] == 1}
    left = dict(x for keys, counts in trie.spill(-1) for x in zip(keys.tolist(), counts.tolist()))
    assert left == {number((2, 1, 1)): 5, number((3, 1, 1)): 1}


def test_many_words_and_languages(spark, monkeypatch):
    """Word numbers start anew, and texts of many languages are counted before a chunk is full."""
    monkeypatch.setattr(c, "CHUNK", 300)
    monkeypatch.setattr(c, "WORDS_HELD", 200)
    rows = texts(5, 300, 400) + [(f"l{i % 40}", "so it is, so it was. " * (i % 7)) for i in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    found = c.collocations(docs, entries=150, min_count=6).select(COLUMNS).collect()
    assert sorted(tuple(r) for r in found) == slow(rows, 6)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_007, 3_000_000_019, 3_000_000_021
    row = spark.range(1).select(c.score(F.lit(a), F.lit(left), F.lit(right)).alias("s"), c.score(F.lit(a), F.lit(a), F.lit(a)).alias("one"), c.score(F.lit(10), F.lit(10**12), F.lit(10**12)).alias("none")).first()
    assert tuple(row) == (1_000_000 * a * a // (left * right), 1_000_000, 0)


def test_odd_documents(odd_docs, no_docs):
    docs = odd_docs.withColumn("lang", F.lit(None).cast("string")).withColumn("words", F.lit(1)).withColumn("f", F.lit("x"))
    rows = c.collocations(docs).select(COLUMNS).collect()
    assert sorted(tuple(r) for r in rows) == slow([(None, r.text) for r in odd_docs.collect()])
    assert rows[0].phrase == "word word word"
    assert c.collocations(no_docs.withColumn("lang", F.lit("en"))).count() == 0
