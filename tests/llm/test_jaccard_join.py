import random

import numpy as np
import pytest

from threadloom.llm import jaccard_join as j


def slow_set(text, width=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow_components(texts, width=4, percent=85):
    sets, group = [slow_set(t, width) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for k, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y) and group[i] != group[k]:
                group = [group[k] if g == group[i] else g for g in group]
    least = {}
    for i, g in enumerate(group):
        least.setdefault(g, i)
    return [least[g] for g in group]


def edited(seed=4, families=20):
    """Texts, each with copies of one to eight edits, a line in common, short ones and empty ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 150, 400]))
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy) + (" the one line that all have in common here" if edits % 2 else ""))
    return texts + [texts[0].upper(), "", " ", None, "one", "One", "a b c d", "a b c e", "a b c d e", "a b c d", "é É", "É é"]


@pytest.mark.parametrize("rounds,orders,block", [(0, 3, 8192), (0, 1, 3), (4, 3, 8192), (2, 2, 3)])
def test_components_as_by_brute_force(spark, rounds, orders, block):
    texts = edited()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: (r.n_shingles, r.component_id) for r in j.similar(docs, rounds=rounds, orders=orders, block=block).collect()}
    assert [found[i] for i in range(len(texts))] == [(len(slow_set(t)), c) for t, c in zip(texts, slow_components(texts))]


@pytest.mark.parametrize("width,percent", [(1, 50), (2, 95), (5, 80), (3, 100)])
def test_other_widths_and_thresholds(spark, width, percent):
    texts = [t for t in edited(7, 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: r.component_id for r in j.similar(docs, width=width, percent=percent).collect()}
    assert [found[i] for i in range(len(texts))] == slow_components(texts, width, percent)


def test_a_large_family_with_stragglers(spark):
    """Near copies of one text, some of which are linked with few others only."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(250):
        copy = list(base)
        for at in rng.sample(range(60), rng.choice([1, 1, 2, 3])):
            copy[at] = f"x{i}.{at}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: r.component_id for r in j.similar(docs, block=50).collect()}
    slow = slow_components(texts)
    assert [found[i] for i in range(len(texts))] == slow and 1 < len(set(slow)) < 250


def test_a_family_of_unlinked_copies_gives_no_pairs(spark, monkeypatch):
    """Copies with edits of their own, each too far from the others: what one has alone comes first and tells them apart."""
    texts = [" ".join(f"x{i}.{w}" if w % 10 == i % 10 else f"b{w}" for w in range(60)) for i in range(200)]
    pairs, real = [], j._all_pairs

    def counted(*args):
        pairs.append(real(*args).count())
        return real(*args)

    monkeypatch.setattr(j, "_all_pairs", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: r.component_id for r in j.similar(docs).collect()}
    assert [found[i] for i in range(len(texts))] == slow_components(texts)
    assert pairs[0] <= len(texts)


def test_prefixes_under_every_order_hold_a_shared_shingle():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n, apart = int(rng.integers(1, 80)), int(rng.integers(0, 12))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, len(a) - apart // 2)], rng.integers(0, 2**63, apart - apart // 2).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 85 * (len(a) + len(b) - shared):
            continue
        assert shared >= j.common_at_least(len(a), len(b), 85)
        small, large = sorted((a, b), key=len)
        for order in (1, 2, 3):
            x, y = j.by_hash(small, order), j.by_hash(large, order)
            assert np.isin(x[: j.short_prefix(len(x), 85)], y[: j.prefix(len(y), 85)]).any()
        p, q = sorted((j.sketch(a), j.sketch(b)), key=len)
        if len(q) > len(p):
            assert len(q) == 2 * len(p)
            q = q[: len(p)] | q[len(p) :]
        differ = sum(int(v).bit_count() for v in p ^ q)
        assert differ <= len(a) + len(b) - 2 * shared


def test_odd_documents(odd_docs, no_docs):
    rows = sorted(((r.id, r.n_shingles, r.component_id) for r in j.similar(odd_docs).collect()), key=repr)
    # Both rows without an id: one is a copy of document 1, the other has no text.
    assert rows == sorted([(1, 7, 1), (2, 7, 1), (2, 7, 1), (None, 7, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 7), (None, 0, None), (8, 1, 8), (9, 1, 9)], key=repr)
    assert j.similar(no_docs).count() == 0


def test_words_of_any_length_and_kind_of_blank():
    texts = [b"", b" ", b"a", b"A  b\tc\n", b" lead and trail ", b"x" * 9000 + b" " + b"x" * 8999 + b"y", "é ß\x1c Ä".encode()]
    for text in texts:
        words = text.lower().split()
        found = j.word_numbers(text)
        assert len(found) == len(words) and len(set(found.tolist())) == len(set(words))
        assert (j.word_numbers(text, at_once=5) == found).all() and (j.word_numbers(text.upper()) == found).all()
    assert len(np.unique(j.word_numbers(b" ".join(str(i).encode() for i in range(200_000))))) == 200_000
