"""Near-duplicate vectors by range search in robust-pruned graphs of overlapping cluster shards."""

import logging
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm import graph
from mailrisk.llm.components import components, roots
from mailrisk.llm.shared import settled
from mailrisk.llm.vectors import matrix, past, streamed, unit, usable

COSINE = 0.93
# expansion goes on from vectors this much below the threshold
SLACK = 0.03
# vectors in a shard; centroids in all, which bounds what the driver holds; sample per centroid
# (few large shards: a query's search costs about as much in a large graph as in a small one, and it visits fewer)
SHARD_ROWS = 6000
MOST_ROWS, MOST_BYTES = 16_384, 64 << 20
MOST_CENTROIDS = 4096
SAMPLE_PER_CENTROID = 24
# a vector belongs to its nearest clusters; queries visit every cluster that can be nearest to a linked vector
OVERLAP = 2
DEGREE, WIDTH = 24, 24
QUERIES_AT_ONCE = 256
# queries of each search task that are compared with all vectors of its shard
AUDIT = 64

log = logging.getLogger(__name__)


def _kmeans(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centers = rows[draw.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        near = (rows @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, rows)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centers)
    return centers


def centroids(classes: DataFrame, shard_rows: int = SHARD_ROWS) -> dict[str, np.ndarray]:
    """Cluster centres of every space by spherical k-means on a bounded sample.

    A space has a centre for each ``shard_rows`` vectors; if that makes more than
    ``MOST_CENTROIDS``, every space gets fewer, and its larger clusters are cut into blocks later.
    Spaces left without a sample have a single cluster.
    """
    counts = {r["space"]: r["count"] for r in classes.groupBy("space").count().orderBy(F.desc("count")).limit(MOST_CENTROIDS).collect()}
    total = sum(counts.values())
    per = max(shard_rows, -(-total // MOST_CENTROIDS))
    wanted = {s: n // per for s, n in counts.items() if n // per > 1}
    if not wanted:
        return {}
    spark = classes.sparkSession
    rates = spark.createDataFrame([(s, k, min(1.0, SAMPLE_PER_CENTROID * k / counts[s])) for s, k in wanted.items()], "space string, k int, rate double")
    draw = F.pmod(F.xxhash64("rep", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)

    def run(key, rows):
        import pandas as pd

        k = int(rows["k"].iloc[0])
        points = unit(np.array(rows.sort_values("rep")["vec"].tolist(), np.float64))
        centers = _kmeans(points, min(k, len(points)))
        return pd.DataFrame({"space": key[0], "center": list(centers)})

    sample = classes.join(rates, "space").where(draw < F.col("rate")).select("space", "k", "rep", F.col("vec").cast("array<double>"))
    found = defaultdict(list)
    for row in sample.groupBy("space").applyInPandas(run, "space string, center array<double>").collect():
        found[row["space"]].append(row["center"])
    return {s: np.array(c) for s, c in found.items()}


def reach(centers: np.ndarray, best: np.ndarray, least: float = COSINE) -> np.ndarray:
    """How much less than the cosine to centre ``best`` a query's cosine to each centre may be.

    A vector at home with centre c is not nearer to any other centre b: its product with b - c is at most
    0.  A query within the angle of ``least`` has a product of at most sin(angle) * |b - c| then.
    """
    if least <= 0:
        return np.full((len(best), len(centers)), 2.0)
    # a little more than the bound, for rounding
    apart = np.sqrt(np.maximum(0, (centers**2).sum(1) + (centers[best] ** 2).sum(1)[:, None] - 2 * centers[best] @ centers.T))
    return np.sqrt(max(0.0, 1 - least * least)) * apart + 1e-6


def assigned(classes: DataFrame, centers: dict[str, np.ndarray], margin: float | None = None, overlap: int = OVERLAP, least: float = COSINE) -> DataFrame:
    """``space, rep, n, vec, home, holds, visits, angles``: unit vectors, the clusters they lie in and look into, and how far off those centres are.

    Without a ``margin`` queries look into every cluster that can be the home of a vector at ``least`` or nearer.
    """
    shared = classes.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        known = shared.value
        for batch in batches:
            spaces = np.array(batch.column(0).to_pylist(), object)
            n = len(spaces)
            home, holds, visits, angles, vec = np.zeros(n, np.int32), [[0]] * n, [[0]] * n, [[0.0]] * n, [None] * n
            for space in set(spaces):
                rows = np.flatnonzero(spaces == space)
                points = unit(matrix(batch.column(3).take(pa.array(rows))))
                for i, p in zip(rows, points):
                    vec[i] = p
                if space in known:
                    near = points @ known[space].T
                    order = np.argsort(-near, axis=1)
                    best = np.take_along_axis(near, order[:, :1], 1)
                    width = reach(known[space], order[:, 0], least) if margin is None else margin
                    angle = np.arccos(np.clip(near, -1, 1))
                    for i, o, hit, away in zip(rows, order, near >= best - width, angle):
                        home[i], holds[i], visits[i] = o[0], o[:overlap].tolist(), np.flatnonzero(hit).tolist()
                        angles[i] = away[visits[i]].tolist()
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(vec, pa.list_(pa.float64())), pa.array(home),
                 pa.array(holds, kinds), pa.array(visits, kinds), pa.array(angles, pa.list_(pa.float64()))],
                ["space", "rep", "n", "vec", "home", "holds", "visits", "angles"],
            )

    return classes.select("space", "rep", "n", F.col("vec").cast("array<double>")).mapInArrow(
        run, "space string, rep long, n long, vec array<double>, home int, holds array<int>, visits array<int>, angles array<double>"
    )


def _built(key, table):
    table = table.sort_by("rep")
    ids = table["rep"].to_numpy()
    near = graph.vamana(matrix(table["vec"], np.float32), DEGREE)
    lists = [ids[row[row >= 0]] for row in near]
    return pa.table({"rep": pa.array(ids), "near": pa.array(lists, pa.list_(pa.int64()))})


class _Shard:
    """A shard's vectors and united lists, ready for queries."""

    def __init__(self, key, members: pa.Table, least: float):
        members = members.sort_by("rep")
        self.key, self.least = key, least
        self.ids, self.count = members["rep"].to_numpy(), members["n"].to_numpy()
        self.own = members["own"].to_numpy(zero_copy_only=False).astype(bool)
        self.exact = matrix(members["vec"])
        self.points = self.exact.astype(np.float32)
        lists = members["near"].combine_chunks()
        flat = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(self.ids)), pc.list_value_length(lists).to_numpy())
        place = np.minimum(np.searchsorted(self.ids, flat), len(self.ids) - 1)
        here = self.ids[place] == flat
        owner, place = owner[here], place[here]
        degree = np.bincount(owner, minlength=len(self.ids))
        self.near = np.full((len(self.ids), max(1, int(degree.max(initial=0)))), -1, np.int32)
        self.near[owner, np.arange(len(owner)) - np.repeat(np.cumsum(degree) - degree, degree)] = place
        self.start = graph.entries(self.points, self.near)
        self.audited, self.whole = 0, False

    def verified(self, q, row, place):
        """In double precision; what is indexed here as overlap only is counted at home."""
        cosine = np.concatenate([np.einsum("ij,ij->i", q[row[i : i + 100_000]], self.exact[place[i : i + 100_000]]) for i in range(0, max(1, len(row)), 100_000)])
        hit = (cosine >= self.least) & self.own[place]
        return row[hit], place[hit]

    def by_graph(self, q):
        met = graph.search(self.points, self.near, q.astype(np.float32), self.start, WIDTH, 2, self.least - SLACK)[2]
        return self.verified(q, *(np.concatenate([m[i] for m in met]) for i in (0, 1)))

    def by_all(self, q):
        return self.verified(q, *np.nonzero(q @ self.exact.T >= self.least - 1e-9))

    def linked(self, q):
        """(query, place) of all links.  The first queries, which come by a hash, are looked up in both ways: should the
        graph have missed one of their links, they and all later ones are compared with the whole shard.
        """
        if self.whole:
            return self.by_all(q)
        found = self.by_graph(q)
        asked = q[: max(0, AUDIT - self.audited)]
        self.audited += len(asked)
        if len(asked) and (lost := len(self.by_all(asked)[0]) - int((found[0] < len(asked)).sum())):
            log.warning("audit of shard %s: %d links of %d queries missed by the graph; the shard is searched whole", self.key, lost, len(asked))
            self.whole = True
            return self.by_all(q)
        return found

    def answers(self, reps: np.ndarray, queries: np.ndarray):
        """``rep, links, low`` rows: counts of links (low -1) and the edges of trees (links 0)."""
        for at in range(0, len(reps), QUERIES_AT_ONCE):
            q, asker = queries[at : at + QUERIES_AT_ONCE], reps[at : at + QUERIES_AT_ONCE]
            row, place = self.linked(q)
            other = self.ids[place] != asker[row]
            row, place = row[other], place[other]
            links = np.bincount(row, weights=self.count[place], minlength=len(q)).astype(np.int64)
            some = np.flatnonzero(links)
            nodes, low = roots(asker[row], self.ids[place])
            nodes, low = nodes[nodes != low], low[nodes != low]
            rows = [np.concatenate([asker[some], nodes]), np.concatenate([links[some], np.zeros(len(nodes), np.int64)]), np.concatenate([np.full(len(some), -1), low])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["rep", "links", "low"])


GROUP = ["space", "cluster", "block", "part"]


def _searched(least: float):
    def run(batches):
        def asked(shard, batch):
            yield from shard.answers(batch.column("rep").to_numpy(), matrix(batch.column("vec")))

        yield from streamed(batches, GROUP, lambda key, members: _Shard(key, members, least), asked)

    return run


def near_duplicates(
    vectors: DataFrame, least: float = COSINE, shard_rows: int = SHARD_ROWS, most_rows: int = MOST_ROWS, margin: float | None = None, same: str | None = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding[, label])``.

    Rows link if their labels are equal and not null, their vectors equally long and their cosine, in
    double precision, at least ``least``.  Unusable vectors (null, zero, not finite) and rows with
    null ids or labels link with nothing: their component is their own id.  Equal vectors of a label are one
    class, searched once and counted by its rows, repeated rows included.

    Queries look into every cluster that can be home to a linked vector, by the bound of ``reach`` and by the cluster's
    radius; a fixed ``margin`` proves nothing.
    Each class lies in its nearest ``OVERLAP`` clusters.  A cluster's shards hold ``most_rows`` at most; one that is larger is cut into
    blocks by a hash, and its queries look into all of them, themselves in blocks.  Every shard gets a
    robust-pruned graph; the adjacency lists of a vector from all its shards are united.  A shard's vectors with the
    united lists are moved once, and its queries stream past them: they start at the medoid, go on greedily and expand
    from all in range.  Each shard audits its graph: its first ``AUDIT`` queries, in the order of a hash, are compared with
    all its vectors, and if a link was missed, all its queries are.  Answers are counts and the edges of trees, never all pairs.
    Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    space = F.concat_ws(":", F.col(same).cast("string") if same else F.lit("all"), F.size("embedding").cast("string"))
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    if same:
        good = good & F.col(same).isNotNull()
    marked = vectors.select(F.col("vec_id").cast("long"), "embedding", F.when(good, space).alias("space"))
    rows = marked.where("space is not null")
    classes = settled(rows.groupBy("space", F.col("embedding").alias("vec")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    known = centroids(classes, shard_rows)
    placed = settled(assigned(classes, known, margin, least=least), "vector-clusters")
    held = placed.select("space", F.explode("holds").alias("cluster"), "home", "rep", "n", "vec")
    fit = F.greatest(F.least(F.lit(most_rows), F.floor(F.lit(MOST_BYTES) / 8 / F.max(F.size("vec")))), F.lit(1))
    sizes = held.groupBy("space", "cluster").agg(F.ceil(F.count("*") / fit).cast("int").alias("blocks"))
    sizes = settled(sizes, "vector-blocks")
    key = ["space", "cluster"]
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    held = held.join(sizes, key).select(*key, block.alias("block"), "blocks", "rep", "n", "vec", (F.col("home") == F.col("cluster")).alias("own"))
    lists = held.select(*key, "block", "rep", "vec").groupBy(*key, "block").applyInArrow(_built, "rep long, near array<long>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    index = held.join(united, "rep").select(*key, "block", every(F.col("blocks")).alias("part"), "rep", "n", "vec", "near", "own", F.lit(0).cast("long").alias("turn"))
    looks = F.explode(F.arrays_zip(F.col("visits").alias("cluster"), F.col("angles").alias("angle"))).alias("v")
    # nobody at home in a cluster is farther from its centre than its radius
    radius = placed.select("space", F.col("home").alias("cluster"), F.element_at("angles", F.array_position("visits", F.col("home")).cast("int")).alias("angle"))
    radius = settled(radius.groupBy(*key).agg(F.max("angle").alias("radius")), "vector-radius")
    near_enough = F.col("angle") <= F.col("radius") + math.acos(min(1.0, max(-1.0, least))) + 1e-6
    asking = placed.select("space", looks, "rep", "vec").select("space", "v.cluster", "v.angle", "rep", "vec").join(radius, key).where(near_enough)
    asking = asking.join(sizes, key).select(*key, block.alias("part"), every(F.col("blocks")).alias("block"), "rep", "vec", F.xxhash64("rep", F.lit(7)).alias("turn"))
    groups = sizes.agg(F.sum(F.col("blocks") * F.col("blocks"))).first()[0] or 1
    # names anew: both sides come from one table
    asking = asking.toDF(*asking.columns)
    found = past(index, asking, GROUP, "turn", int(groups)).mapInArrow(_searched(least), "rep long, links long, low long")
    found = settled(found, "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("low >= 0").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    named = (
        classes.join(links, "rep", "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("space", F.col("vec"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    full = marked.join(named, (marked["space"] == named["space"]) & (marked["embedding"] == named["vec"]), "left")
    return full.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
