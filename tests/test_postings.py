import numpy as np
import pytest

from threadloom.operators import postings, similarity

TERMS = 60


def sparse(seed, n, frequent=0.9):
    """Rows of few terms; term 0 in most of them, some rows alike, one row empty."""
    rng = np.random.default_rng(seed)
    rows = np.zeros((n, TERMS))
    for i in range(n - 1):
        at = rng.choice(np.arange(1, TERMS), rng.integers(1, 7), replace=False)
        rows[i, at] = rng.random(len(at)) * rng.choice([0.2, 1, 3])
        rows[i, 0] = rng.random() * (rng.random() < frequent)
    rows[n // 2 : n // 2 + n // 4] = rows[n // 2]
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def table(spark, rows):
    data = [(i, [int(t) for t in np.nonzero(r)[0]], [float(w) for w in r[np.nonzero(r)[0]]]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "id bigint, indices array<int>, values array<double>")


def brute(q, d, k, floor, skip_same):
    scores = np.round(q @ d.T, 9)
    out = {}
    for i, row in enumerate(scores):
        order = sorted((-s, j) for j, s in enumerate(row) if s >= floor and not (skip_same and i == j))[:k]
        out.update({(i, j): (r, -s) for r, (s, j) in enumerate(order, 1)})
    return out


@pytest.mark.parametrize("k,floor,skip_same,seeds,block", [(1, 1e-9, False, 3, 100_000), (5, 1e-9, True, 1, 7), (3, 0.5, False, 2, 20), (400, 1e-9, False, 3, 50)])
def test_as_by_all_pairs(spark, k, floor, skip_same, seeds, block):
    q, d = sparse(1, 40), sparse(2, 240)
    if skip_same:
        q = d[:60]
    index = postings.build_postings(table(spark, d), block)
    got = {(r.q_id, r.d_id): (r["rank"], r.score) for r in index.search(table(spark, q), k, floor, skip_same, seeds).collect()}
    want = brute(q, d, k, floor, skip_same)
    assert got.keys() == want.keys()
    assert all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-8 for p in want)


def test_terms_that_cannot_matter_are_not_looked_up(spark):
    """Queries with a rare term and the term that most documents have: once the rare one gave a result, the lists of the others stay unread."""
    d = np.zeros((500, TERMS))
    d[:, 0], d[:, 1] = 0.1, 1.0
    d[:20, 2] = 30.0
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    q = np.zeros((1, TERMS))
    q[0, :3] = [0.05, 0.05, 1.0]
    index = postings.build_postings(table(spark, d))
    asked = []
    whole = index._partial

    def watched(terms, skip_same):
        asked.append({r.term for r in terms.select("term").collect()})
        return whole(terms, skip_same)

    index._partial = watched
    assert index.search(table(spark, q), 5, seeds=1).count() == 5
    assert asked[1] == {2}


def test_saved_index_and_empty_sides(spark, tmp_path):
    d = sparse(3, 30)
    postings.build_postings(table(spark, d)).save(str(tmp_path / "i"))
    index = postings.PostingIndex.load(spark, str(tmp_path / "i"))
    got = {(r.q_id, r.d_id) for r in index.search(table(spark, d), 2).collect()}
    assert got == set(brute(d, d, 2, 1e-9, False))
    nothing = table(spark, d).limit(0)
    assert index.search(nothing, 2).count() == 0
    assert postings.sparse_top_k(table(spark, d), nothing, 2).count() == 0


@pytest.mark.parametrize("k,floor,skip_same,held", [(1, 1e-9, True, 1 << 20), (5, 1e-9, False, 900), (400, 0.2, True, 900)])
def test_held_lists_as_by_all_pairs(spark, k, floor, skip_same, held):
    d = sparse(6, 240)
    found = similarity.sparse_top_k_held(table(spark, d), table(spark, d), k, TERMS, floor, skip_same, held)
    got, want = {(r.q_id, r.d_id): (r["rank"], r.score) for r in found.collect()}, brute(d, d, k, floor, skip_same)
    assert got.keys() == want.keys()
    assert all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-8 for p in want)


def test_pairs_that_share_a_term_are_not_written(spark):
    """All rows share a term: what leaves the tasks is k for each query and part, not every pair."""
    d = table(spark, sparse(8, 300, frequent=1.0))
    asked, held = similarity.held_grid(d, d, 1000, 2000, 4)
    assert similarity._pass_by_sparse(asked, held, 1, TERMS, True, 1e-9).count() <= 300 * asked.select("slot").distinct().count()
