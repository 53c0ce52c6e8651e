import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import periodic_runs as p


def slow_runs(words, min_length=6, min_periods=4):
    """Every lag, every stretch; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(words) + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_periods * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def numbers(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_runs_as_by_every_lag(parts):
    words = [w for part, times in parts for w in part * times]
    assert p.runs_of(numbers(words)) == slow_runs(words)


@pytest.mark.parametrize("period", [1, 2, 5, 6, 7, 17, 18, 19, 57, 58, 200])
@pytest.mark.parametrize("times", [3.9, 4, 4.5, 11])
def test_periods_at_the_edges_of_classes(period, times):
    rng = random.Random(period)
    part = [rng.randrange(1000) for _ in range(period)]
    length = int(period * times)
    words = [-1, -2] + [part[i % period] for i in range(length)] + [-3]
    assert p.runs_of(numbers(words)) == slow_runs(words)


@pytest.mark.parametrize("min_length,min_periods", [(3, 3), (10, 3), (1, 5), (40, 4), (6, 2)])
def test_other_settings(min_length, min_periods):
    rng = random.Random(9)
    for _ in range(60):
        words = [w for _ in range(5) for w in [rng.randrange(3) for _ in range(rng.randint(1, 8))] * rng.randint(1, 7)]
        assert p.runs_of(numbers(words), min_length, min_periods) == slow_runs(words, min_length, min_periods)


def test_seed_lengths_serve_all_periods():
    for words in (5, 6, 100, 5000):
        last = 0
        for k in p.seed_lengths(words):
            assert all(k >= q and k <= max(3 * q, 6 - q) for q in range(last + 1, min(k, words // 4) + 1))
            last = k
        assert last >= words // 4 or words < 6


def test_long_texts_take_little():
    rng = np.random.default_rng(1)
    part = rng.integers(0, 50_000, 90_000)
    assert p.runs_of(np.tile(part, 5)) == [(0, 450_000, 90_000)]
    assert p.runs_of(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    # Fibonacci words hold very many squares and cubes, and no fourth power.
    a, b = [0], [0, 1]
    while len(b) < 200_000:
        a, b = b, b + a
    assert p.runs_of(np.array(b, np.int64)) == []


def slow_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_as_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        parts = [" ".join(rng.choices(["a", "B", "ccc", "dé"], k=rng.randint(1, 6))) for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(" ".join([x] * rng.randint(1, 8)) for x in parts), i))
    rows += [(1000, None, 0), (1001, "", 0), (1002, " \r\n ", 0), (None, "x " * 40, 0), (1003, "w\x1cw " * 9, 0), (7, rows[7][1], 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs long").write.parquet(str(tmp_path / "documents.parquet"))
    found = [tuple(r) for r in p.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted((slow_row(i, t) for i, t, _ in rows), key=repr)
    assert any(r[1] > 1 for r in found) and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[2] is not None for r in found if r[0] is not None)


def test_odd_documents(odd_docs, no_docs):
    rows = p.find_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    long = next(r for r in rows if r.id == 6)
    assert (long.n_words, [tuple(x) for x in long.runs], long.collapsed) == (60_000, [(0, 60_000, 1)], "word")
    assert next(r for r in rows if r.id == 3).collapsed == ""
    assert p.find_runs(no_docs).count() == 0
