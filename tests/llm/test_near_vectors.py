"""Near vectors: routing as in production, and the audit of searches."""

import numpy as np
import pyarrow as pa
import pytest

from mailrisk.llm import graph, neardup_vectors
from mailrisk.llm.vectors import unit


@pytest.mark.parametrize("d", [8, 16, 64])
def test_routing_reaches_every_link(spark, d):
    """Random unit vectors, each linked with one at cosine 0.935: its home is among the visited clusters."""
    draw = np.random.default_rng(d)
    n = 4000
    points = unit(draw.normal(size=(n, d)))
    aside = draw.normal(size=(n, d))
    aside = unit(aside - (aside * points).sum(1, keepdims=True) * points)
    both = np.concatenate([points, 0.935 * points + np.sqrt(1 - 0.935**2) * aside])
    centers = {"x": neardup_vectors._kmeans(points, 40)}
    table = spark.createDataFrame([("x", i, 1, v.tolist()) for i, v in enumerate(both)], "space string, rep long, n long, vec array<double>")
    rows = {r.rep: r for r in neardup_vectors.assigned(table, centers).select("rep", "home", "visits").collect()}
    lost = sum(rows[b].home not in rows[a].visits for i in range(n) for a, b in ((i, n + i), (n + i, i)))
    assert lost == 0


def table_of(ids, points, **more):
    return pa.table({"rep": pa.array(ids, pa.int64()), "vec": pa.array(points.tolist(), pa.list_(pa.float64())), **more})


def test_audit_searches_failing_shards_whole(monkeypatch):
    """A search that loses a third of what it meets gives all links all the same."""
    draw = np.random.default_rng(2)
    n = 300
    points = draw.normal(size=(n, 16))
    points[100:160] = points[100] + draw.normal(size=(60, 16)) * 0.05
    points = unit(points)
    ids = np.arange(n) * 3
    near = neardup_vectors._built((), table_of(ids, points))["near"]
    members = table_of(ids, points, near=near, n=pa.array([1] * n, pa.int64()), own=pa.array([True] * n))
    whole = graph.search

    def lossy(*args):
        out = whole(*args)
        return (*out[:2], [(row[place % 3 > 0], place[place % 3 > 0]) for row, place in out[2]])

    monkeypatch.setattr(graph, "search", lossy)
    # queries in the order in which production sends them, some of a linked group among the first
    order = np.concatenate([np.arange(100, 110), draw.permutation(np.delete(np.arange(n), np.arange(100, 110)))])
    shard = neardup_vectors._Shard((), members, 0.93)
    found = [r for b in shard.answers(ids[order], points[order]) for r in b.to_pylist()]
    got = {r["rep"]: r["links"] for r in found if r["low"] < 0}
    assert shard.whole
    want = (points @ points.T >= 0.93).sum(1) - 1
    assert got == {int(i): int(k) for i, k in zip(ids, want) if k}


@pytest.mark.parametrize("shard_rows, most_rows", [(60, 4096), (60, 25)])
def test_counts_as_in_production(spark, shard_rows, most_rows):
    """Low dimension, several clusters, the production routing: all counts equal brute force."""
    draw = np.random.default_rng(4)
    points = unit(draw.normal(size=(600, 6)))
    table = spark.createDataFrame([(i, p.tolist(), 1) for i, p in enumerate(points)], "vec_id long, embedding array<double>, label int")
    found = neardup_vectors.near_duplicates(table, shard_rows=shard_rows, most_rows=most_rows).collect()
    want = (points @ points.T >= 0.93).sum(1) - 1
    assert {r.vec_id: r.n_links for r in found} == dict(enumerate(want.tolist()))
