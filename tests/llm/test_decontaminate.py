import random

from threadloom.llm import decontaminate as d

ITEM = "On the third day the copper kettle sang louder than the old harbour bell and nobody in the village slept"
OTHER = "Seven quiet gardeners counted the fallen pears beneath a broken lantern before the first snow"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, leaks string")


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def slow_score(item, text):
    a, b = d.words_of(item), d.words_of(text)
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (d.MATCH if x == y else d.MISMATCH), row[j] + d.GAP, new[j - 1] + d.GAP))
        row = new
        best = max(best, *row)
    return best


def test_alignment_as_by_the_full_table():
    rng = random.Random(3)
    for _ in range(200):
        words = "a b c d e".split()
        item, text = " ".join(rng.choices(words, k=rng.randint(1, 12))), " ".join(rng.choices(words + ["x", "y"], k=rng.randint(1, 30)))
        block = d.Items.of([(1, item)])
        assert d.align(block.words[0], block.numbers(text))[0] == slow_score(item, text)


def test_exact_edited_and_clean(spark):
    words = ITEM.split()
    edited = " ".join(w if i % 7 else "other" for i, w in enumerate(words))
    shouted = ITEM.upper().replace(" ", ", ")
    rows = [(1, f"Before it. {ITEM}. After it."), (2, f"x y z {edited} z y x"), (3, shouted), (4, "the old harbour bell was quiet"), (5, None), (6, ""), (None, ITEM), (7, "filler " * 50_000 + OTHER), (7, ITEM + " " + OTHER)]
    table, items = docs(spark, rows), bench(spark, [(10, ITEM), (11, OTHER), (12, None), (13, ""), (14, "zebra quagga"), (None, "unseen text of an item without id")])
    for block_bytes in (d.BLOCK_BYTES, 60):
        found = d.leaks(table, items, block_bytes=block_bytes).collect()
        assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == sorted([(1, 10), (2, 10), (3, 10), (None, 10), (7, 11), (7, 10), (7, 11)], key=str)
        for r in found:
            text = [t for i, t in rows if i == r.doc_id and t and d.words_of(t[r.start : r.end])[:1] in (["on"], ["seven"], ["the"])]
            assert text and 0.4 <= r.score <= 1
        kept = d.clean(table, items, block_bytes=block_bytes)
        assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6]
    assert next(r.score for r in found if r.doc_id == 1) == 1


def test_edited_copies_as_by_the_full_alignment(spark):
    """Every second, third and fourth word replaced, left out, or followed by another: all pairs against the full table."""
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(60)], k=n))) for i, n in enumerate([3, 4, 7, 12, 20, 45])]
    rows = []
    for _, item in items:
        for every in (1, 2, 3, 4, 7):
            for first in range(min(every, 2)):
                hit = [k % every == first for k in range(len(item.split()))]
                for edit in (lambda w: "zz", lambda w: "", lambda w: f"{w} zz"):
                    copy = " ".join(edit(w) if h else w for w, h in zip(item.split(), hit))
                    rows.append((len(rows), f"{' yy' * 30} {copy} {'yy ' * 30}"))
    want = {(d_id, i): slow_score(item, text) / (d.MATCH * len(item.split())) for d_id, text in rows for i, item in items}
    found = {(r.doc_id, r.item_id): r.score for r in d.leaks(docs(spark, rows), bench(spark, items)).collect()}
    assert found == {k: v for k, v in want.items() if v >= d.MIN_SCORE}


def test_frequent_passage_is_still_found(spark):
    table = docs(spark, [(i, f"doc {i} {ITEM}") for i in range(300)])
    assert d.leaks(table, bench(spark, [(1, ITEM), (2, ITEM)])).count() == 600


def test_short_items(spark):
    found = d.leaks(docs(spark, [(1, "saw zebra quagga there"), (2, "zebra alone")]), bench(spark, [(1, "zebra quagga"), (2, "quagga")]))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1, 1), (1, 2)]


def test_empty_tables(spark, odd_docs, no_docs):
    items = bench(spark, [(1, ITEM)])
    assert d.leaks(no_docs, items).count() == 0 and d.leaks(odd_docs, items.limit(0)).count() == 0
    assert d.clean(odd_docs, items.limit(0)).count() == odd_docs.count() and d.clean(no_docs, items).columns == no_docs.columns


def test_words_cut_as_a_whole_as_one_by_one():
    texts = ["", "A b_c9, d-e\tF\x1cg\x00h'i", "It's 3.5% (OK)?", "Ünder_Ärger, ΟΔΟΣ İx", "“Žluť”—Œuvre… ²ª \x81\x85\xa0x", "".join(map(chr, range(1, 0x2200))), "".join(chr(c) + " x" for c in range(1, 256)), None]
    assert [d.words_of(t) for t in texts] == [[w.lower() for w in d.WORD.findall(t or "")] for t in texts]
