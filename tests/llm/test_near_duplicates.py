import random

import pytest

from threadloom.llm import near_duplicates as n
from threadloom.llm import simhash


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(texts):
    sets, group = [slow_set(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if (x == y or 5 * len(x & y) >= 4 * len(x | y)) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for i, g in enumerate(group):
        least.setdefault(g, i)
    return [least[g] for g in group]


def edited_copies():
    """Texts, each with copies of one to twelve edits, a line in common, and short and empty ones."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 150, 400]))
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 5, 8, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy) + (" the one line that all have in common here" if edits % 2 else ""))
    return texts + [texts[0].upper(), "", " ", "one", "One", "a b c d", "a b c e"]


@pytest.mark.parametrize("rounds", [0, 2])
def test_components_as_by_brute_force(spark, rounds):
    texts = edited_copies()
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    found = {r.row_id: r.component for r in n.cluster(rows, rounds=rounds).collect()}
    assert [found[i] for i in range(len(texts))] == slow_components(texts)


def test_the_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    texts = edited_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert kept == sorted(set(slow_components(texts)))
    assert len(kept) < simhash.keep_one(docs).count()


def test_odd_documents(odd_docs, no_docs):
    kept = n.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 8, 9]
    assert n.keep_one(no_docs).count() == 0


def test_the_pipeline_stage_links_by_fingerprints_too(spark, monkeypatch):
    """Texts whose fingerprints are close are linked whatever their shingles; so are chains of both kinds of links."""
    import corpus_pipeline

    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcd"] + [" ".join(f"b{i}" for i in range(41))]
    close = {texts[0]: 0, texts[1]: 3, texts[2]: 0xFF00, texts[3]: 0xFF << 30, texts[4]: 0xFF << 50}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, text="text", id_col="doc_id", width=3: spark.createDataFrame(
        [(r[0], close[r[1]]) for r in docs.select(id_col, text).collect()], "id long, fp long"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [0, 2, 3]


def test_components_of_both_kinds_of_links(spark):
    texts = edited_copies()
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    prints = [simhash.fingerprint((t or "").encode()) for t in texts]
    place = slow_components(texts)
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 2 and place[i] != place[j]:
                low, high = sorted((place[i], place[j]))
                place = [low if c == high else c for c in place]
    found = {r.row_id: r.component for r in n.cluster_by_both(rows).collect()}
    assert [found[i] for i in range(len(texts))] == place


def test_both_kinds_of_links_share_the_rounds_of_components(spark, monkeypatch):
    from threadloom.llm import jaccard_join

    calls = []
    for module in (n, simhash, jaccard_join):
        if hasattr(module, "components"):
            monkeypatch.setattr(module, "components", lambda links, f=module.components: calls.append(1) or f(links))
    n.cluster_by_both(spark.createDataFrame(list(enumerate(edited_copies())), "row_id long, text string"))
    assert 1 <= len(calls) <= jaccard_join.ROUNDS + 1
