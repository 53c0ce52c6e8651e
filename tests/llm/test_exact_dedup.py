import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import exact_dedup as x


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").encode().lower()].append(r)
    out = []
    for text, members in groups.items():
        ids = [m.doc_id for m in members if m.doc_id is not None]
        for m in members:
            out.append((m.doc_id, max(ids) if ids else None, len(members), hashlib.sha256(text).hexdigest()))
    return sorted(out, key=str)


def test_groups_as_by_brute_force(odd_docs):
    for limit in (x.TABLE_BYTES, 1):  # a table of one text spills all others
        rows = x.resolve(odd_docs, limit=limit).collect()
        assert sorted(((r.row.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == expected(odd_docs.collect())


def test_one_row_stays_with_all_its_columns(odd_docs):
    kept = x.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [(r.text or "").lower() for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len(expected(odd_docs.collect())) - 5
    assert {r.doc_id for r in kept.collect() if r.text and "quick" in r.text} == {2}


def test_empty_table(no_docs):
    assert x.resolve(no_docs).count() == 0 and x.deduplicate(no_docs).columns == no_docs.columns


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=3), max_size=40), st.integers(1, 400))
def test_table_compares_contents(contents, limit):
    table, known = x.ContentTable(limit), {}
    for i, c in enumerate(contents):
        found = table.lookup(len(c) % 2, c, i)  # two digests for all contents: collisions everywhere
        if found is None:
            assert c not in known
        else:
            assert known.setdefault(c, found) == found
