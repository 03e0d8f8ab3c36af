"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinledger.llm import ann, embedding_dedup
from twinledger.llm.scratch import reachable

SCHEMA = "vec_id long, embedding array<float>, rank string, kept string"


def table(spark, rows):
    return reachable(spark).createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], None, None) for i, v in rows], SCHEMA).repartition(3)


def some(seed, n=300, size=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, size)).astype(np.float32)
    near = base[:60] + 0.03 * rng.standard_normal((60, size)).astype(np.float32)
    hot = base[5] + 0.05 * rng.standard_normal((80, size)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(np.concatenate([base, near, hot, base[:20], 3 * base[:5]]))]
    odd = [(9001, None), (9002, [0.0] * size), (9003, [float("nan")] * size), (9004, [float("inf")] + [1.0] * (size - 1)),
           (9005, [None] + [1.0] * (size - 1)), (9006, []), (9007, [1.0, 2.0]), (9008, [2.0, 4.0]), (9009, [-1.0, 2.0])]
    return rows + odd


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def cosine(a, b):
    a, b = np.asarray(a, np.float32).astype(float), np.asarray(b, np.float32).astype(float)
    return a @ b / np.sqrt((a @ a) * (b @ b))


@pytest.mark.parametrize("block_rows", [4096, 24])
def test_links_and_components(spark, block_rows):
    rows = some(1)
    n = len(rows)
    links, label = [0] * n, list(range(n))
    for k in range(n):
        for j in range(k):
            a, b = rows[k][1], rows[j][1]
            if good(a) and good(b) and len(a) == len(b) and cosine(a, b) >= 0.95:
                links[k] += 1
                links[j] += 1
                x, y = label[k], label[j]
                if x != y:
                    label = [min(x, y) if z in (x, y) else z for z in label]
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(table(spark, rows), leaf_rows=30, block_rows=block_rows).collect()}
    assert len(found) == n
    assert sum(found[i].n_links for i, _ in rows) >= 0.99 * sum(links) > 1000
    exact = embedding_dedup.near_duplicates(table(spark, rows), leaf_rows=10_000, trees=2, block_rows=block_rows).collect()
    for r in exact:
        k = [i for i, _ in rows].index(r.vec_id)
        assert (r.n_links, r.component_id, r.kept) == (links[k], rows[label[k]][0], label[k] == k)


def test_links_of_repeated_rows_and_nothing(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (None, [0.0, 1.0])]
    found = sorted(((r.vec_id or 0, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table(spark, rows)).collect()))
    assert found == [(0, 1, 3), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def neighbours(rows, query, k):
    q = np.asarray(dict(rows)[query], np.float32).astype(float)
    scored = [(-float((np.asarray(v, np.float32).astype(float) * q).sum()), i) for i, v in rows
              if i != query and good(v) and len(v) == len(q)]
    return sorted(scored)[:k]


def test_search_recall_and_scores(spark):
    rows = some(2, n=1500)
    found = ann.search(table(spark, rows), F.col("vec_id") % 20 == 0, least_rows=100).collect()
    hits = total = 0
    for query in {r.query_id for r in found}:
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == query)
        true = neighbours(rows, query, 20)
        assert [m[0] for m in mine] == list(range(1, len(true) + 1))
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(mine, mine[1:]))
        hits += len({m[1] for m in mine} & {i for _, i in true})
        total += len(true)
    assert {r.query_id for r in found} == {i for i, v in rows if i % 20 == 0 and good(v)}
    assert hits >= 0.9 * total


def test_search_of_all_lists_is_exact(spark):
    rows = some(3, n=200)
    found = ann.search(
        table(spark, rows), F.col("vec_id") % 20 == 0, epsilon=100.0, block_rows=40, block_queries=5, probe_share=1.0).collect()
    for query in {r.query_id for r in found}:
        mine = [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == query]
        true = neighbours(rows, query, 20)
        assert [i for i, _ in mine] == [i for _, i in true]
        assert np.allclose([s for _, s in mine], [-s for s, _ in true], rtol=0, atol=1e-9)


def test_search_of_few_rows_and_nothing(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0]), (None, [1.0, 0.0])]
    found = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(table(spark, rows), F.col("vec_id") % 20 == 0).collect())
    assert found == [(0, 1, 7), (0, 2, 20), (0, 3, 8), (20, 1, 0), (20, 2, 7), (20, 3, 8)]
    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_links_inside_one_large_group(spark):
    """A third of the rows are near copies of one vector, many times more than a leaf is meant to hold."""
    rng = np.random.default_rng(4)
    values = rng.standard_normal((3000, 32)).astype(np.float32)
    values[:1000] = values[0] + 0.1 * rng.standard_normal((1000, 32)).astype(np.float32)
    whole = values.astype(np.float64)
    whole /= np.sqrt((whole * whole).sum(axis=1, keepdims=True))
    true = (whole @ whole.T >= 0.95).sum(axis=1) - 1
    found = embedding_dedup.near_duplicates(table(spark, list(enumerate(values))), leaf_rows=15, sample_rows=2000, block_rows=300).collect()
    links = {r.vec_id: r.n_links for r in found}
    assert true.sum() > 900_000
    assert all(links[i] <= n for i, n in enumerate(true))
    assert sum(links.values()) >= 0.99 * true.sum()
    assert {r.component_id for r in found if r.vec_id < 1000} == {0}


def test_search_recall_on_uneven_lengths(spark):
    rng = np.random.default_rng(6)
    values = rng.standard_normal((3000, 32))
    values *= np.exp(0.6 * rng.standard_normal((3000, 1))) / np.linalg.norm(values, axis=1, keepdims=True)
    rows = list(enumerate(values.astype(np.float32)))
    found = ann.search(table(spark, rows), F.col("vec_id") % 100 == 0, least_rows=100).collect()
    hits = sum(len({r.vec_id for r in found if r.query_id == q} & {i for _, i in neighbours(rows, q, 20)}) for q in range(0, 3000, 100))
    assert hits >= 0.9 * 20 * 30


def test_search_of_repeated_rows(spark):
    rng = np.random.default_rng(8)
    rows = list(enumerate(rng.standard_normal((300, 16)).astype(np.float32)))
    plain = {(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(table(spark, rows), F.col("vec_id") % 20 == 0).collect()}
    twice = ann.search(table(spark, rows * 2), F.col("vec_id") % 20 == 0).collect()
    assert len(twice) == len(plain) == 15 * 20
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(twice)] == [p[:3] for p in sorted(plain)]
    # Several vectors under one vec_id: the best score of each pair of ids counts.
    more = rows + [(i, v) for (i, _), (_, v) in zip(rows[:200], rows[100:])]
    found = ann.search(table(spark, more), F.col("vec_id") % 20 == 0, probe_share=1.0, epsilon=100.0, block_rows=40, block_queries=5).collect()
    for query in range(0, 300, 20):
        best = {}
        for i, v in more:
            for j, q in more:
                if j == query and i != query:
                    best[i] = max(best.get(i, -np.inf), float(v.astype(float) @ q.astype(float)))
        true = sorted((-score, i) for i, score in best.items())[:20]
        mine = sorted((r.rank, r.vec_id) for r in found if r.query_id == query)
        assert mine == [(k + 1, i) for k, (_, i) in enumerate(true)]
