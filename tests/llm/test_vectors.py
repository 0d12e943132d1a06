"""Vector operators against brute force, with several shards and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailrisk.llm import ann, graph, neardup_vectors

ROWS = "vec_id long, embedding array<double>, label int, n long, space string"


def sample(seed=0, n=500, d=16):
    draw = np.random.default_rng(seed)
    points = draw.normal(size=(n, d))
    points[50:120] = points[50] + draw.normal(size=(70, d)) * 0.05
    points[200:204] = points[200]
    points[300:340:2] = points[301:341:2] + draw.normal(size=(20, d)) * 0.1
    points[400] *= 1e-150
    points[401] = points[400] * 1e100
    label = draw.integers(0, 3, n)
    label[50:400] = 1
    rows = [(int(i) * 5, p.tolist(), int(c), 1, "x") for i, (p, c) in enumerate(zip(points, label))]
    nan, inf = float("nan"), float("inf")
    bad = [(9001, None, 1), (9002, [0.0] * d, 1), (9003, [None, *[1.0] * (d - 1)], 1), (9004, [nan] * d, 1), (9005, [inf, *[1.0] * (d - 1)], 1), (9006, [], 1), (9007, points[60].tolist(), None)]
    rows += [(*b, 1, "x") for b in bad] + [(9010, points[60].tolist()[:-1], 1, 1, "x"), (None, points[60].tolist(), 1, 1, "x")]
    return rows + [rows[60]] * 2


@pytest.mark.parametrize("shard_rows, most_rows", [(1500, 4096), (60, 4096), (60, 25)])
def test_near_duplicates(spark, shard_rows, most_rows):
    rows = sample()
    table = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("rep", "shard", "part", "kind", "cluster", "place")})
    found = neardup_vectors.near_duplicates(table, shard_rows=shard_rows, most_rows=most_rows, margin=0.4).collect()
    assert len(found) == len(rows)
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[0] < 9001]
    points = np.array([r[1] for r in good])
    points /= np.abs(points).max(1, keepdims=True)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    near = (points @ points.T >= 0.93) & (label[:, None] == label)
    ids = np.array([r[0] for r in good])
    low = ids.copy()
    for _ in range(20):
        low = np.array([low[row].min() for row in near])
    want = {i: (int(row.sum()) - 1, int(c)) for i, row, c in zip(ids, near, low)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in found if r.vec_id is not None and r.vec_id < 9001}
    assert got == want
    for r in found:
        if r.vec_id is None or r.vec_id >= 9001:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert r.kept == (r.vec_id == r.component_id)
    assert neardup_vectors.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows, query_rows", [(4096, 4096), (90, 7)])
def test_nearest(spark, shard_rows, query_rows):
    rows = sample(3)
    table = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("rep", "shard", "part", "kind", "cluster", "place")})
    found = ann.search(ann.index(table, shard_rows), table, F.col("vec_id") % 20 == 0, query_rows=query_rows).collect()
    good = {r[0]: np.array(r[1]) for r in rows if r[0] is not None and r[0] < 9001} | {9007: np.array(rows[60][1])}
    ids = np.array(sorted(good))
    points = np.array([good[i] for i in ids])
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == {i for i in ids if i % 20 == 0}
    hits = 0
    for query, own in by_query.items():
        own.sort(key=lambda r: r.rank)
        score = points @ good[query]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != query][:20]
        assert [r.rank for r in own] == list(range(1, 21)) and len({r.vec_id for r in own}) == 20
        assert all(r.score == pytest.approx(float(good[r.vec_id] @ good[query]), rel=1e-12, abs=1e-300) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {int(ids[i]) for i in order})
    assert hits >= 0.95 * 20 * len(by_query)
    assert ann.search(ann.index(table.limit(0)), table.limit(0), F.lit(True)).count() == 0
    few = table.where("vec_id in (0, 5, 10)")
    assert ann.search(ann.index(few), few, F.col("vec_id") == 0).count() == 2


def test_graphs_reach_everything():
    draw = np.random.default_rng(1)
    points = draw.normal(size=(700, 12)).astype(np.float32)
    points[100:400] = points[100] + draw.normal(size=(300, 12)).astype(np.float32) * 0.01
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    flat = graph.vamana(points)
    start = graph.entries(points, flat)
    met = graph.search(points, flat, points[:50], start, 24, 2, 0.9)[2]
    found = np.zeros((50, 700), bool)
    for row, place in met:
        found[row, place] = True
    true = points[:50] @ points.T >= 0.9
    assert (found & true).sum() >= 0.99 * true.sum()
    layers = graph.hnsw(points)
    top = np.flatnonzero((layers[-1] >= 0).any(1))[:1]
    place = graph.search(points, layers[0], points[400:450], graph.descend(points, layers[1:], points[400:450], top), 64)[0]
    want = np.argsort(-(points[400:450] @ points.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(place[:, :10], want)]) > 0.95
    assert graph.hnsw(points[:1])[0].shape[0] == 1 and (graph.vamana(points[:1]) == -1).all()
