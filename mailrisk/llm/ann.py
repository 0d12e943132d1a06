"""Nearest neighbours by inner product from navigable small-world graphs, one per shard."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailrisk.llm import graph
from mailrisk.llm.shared import settled
from mailrisk.llm.vectors import SPARSE, matrix, past, streamed, usable

NEAREST = 20
# a shard has as many rows as fit the bytes, but not so many that there are fewer shards than tasks at a time
LEAST_ROWS, SHARD_BYTES = 4096, 64 << 20
QUERY_ROWS = 262_144
DEGREE, BUILD_WIDTH, WIDTH = 16, 96, 96
QUERIES_AT_ONCE = 256


def lifted(rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit rows of one more dimension, in which nearness is the inner product over a constant."""
    longest = float(np.linalg.norm(rows, axis=1).max())
    scaled = rows / longest
    rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
    return np.concatenate([scaled, rest[:, None]], 1).astype(np.float32), longest


def _built(key, table):
    """Rows of a shard in place order, each with its neighbours in all layers one after the other."""
    table = table.sort_by("vec_id")
    layers = graph.hnsw(lifted(matrix(table["vec"]))[0], DEGREE, BUILD_WIDTH)
    flat = np.concatenate(layers, 1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
    return pa.table(
        {"space": table["space"], "shard": table["shard"], "vec_id": table["vec_id"], "vec": table["vec"],
         "place": pa.array(np.arange(len(flat), dtype=np.int32)), "near": lists}
    )


def index(vectors: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """``space, shard, vec_id, vec, place, near``: the graphs of all usable vectors with an id.

    Vectors of one dimension are a space; its rows are dealt by a hash of the id into shards of about ``shard_rows``.
    Every query meets every shard, so shards are as large as ``SHARD_BYTES`` of vectors allow, as long as each task that
    the cluster runs at a time gets one.  Equal (vec_id, embedding) rows are one; null ids and unusable vectors are left
    out; other columns are ignored; an empty table has no shards.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.size("embedding").alias("space"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")
    )
    rows = settled(rows.distinct(), "ann-rows")
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    most = F.floor(F.lit(SHARD_BYTES) / 8 / F.col("space"))
    fair = F.greatest(F.least(most, F.ceil(F.col("n") / tasks)), F.lit(LEAST_ROWS)) if shard_rows is None else F.lit(shard_rows)
    sizes = rows.groupBy("space").agg(F.count("*").alias("n")).select("space", F.ceil(F.col("n") / fair).cast("int").alias("shards"))
    dealt = rows.join(sizes, "space").select(
        "space", F.pmod(F.xxhash64("vec_id", F.lit(13)), F.col("shards")).cast("int").alias("shard"), "vec_id", "vec"
    )
    # a task per shard, as building is what takes time: more partitions than shards, so that few hash to the same one
    shards = sizes.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]
    dealt = dealt.repartition(SPARSE * int(shards), "space", "shard")
    schema = "space int, shard int, vec_id long, vec array<double>, place int, near array<int>"
    return settled(dealt.groupBy("space", "shard").applyInArrow(_built, schema), "ann-index")


class _Shard:
    """A shard's graph, ready for queries."""

    def __init__(self, key, table: pa.Table):
        table = table.sort_by("place")
        self.ids, self.exact = table["vec_id"].to_numpy(), matrix(table["vec"])
        self.points = lifted(self.exact)[0]
        flat = matrix(table["near"], np.int32)
        self.layers = [flat[:, : 2 * DEGREE]]
        if flat.shape[1] > 2 * DEGREE:
            self.layers += np.split(flat[:, 2 * DEGREE :], range(DEGREE, flat.shape[1] - 2 * DEGREE, DEGREE), axis=1)
        lived = np.flatnonzero((self.layers[-1] >= 0).any(1))
        self.top = lived[:1] if len(lived) else np.zeros(1, np.int64)

    def nearest(self, own: np.ndarray, q: np.ndarray, nearest: int, width: int):
        """``(query, vec_id, score)`` of each query's best, scores in double precision."""
        flat_q = np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], 1).astype(np.float32)
        start = graph.descend(self.points, self.layers[1:], flat_q, self.top)
        start = np.concatenate([start, np.broadcast_to(self.top, (len(q), 1))], 1)
        place = graph.search(self.points, self.layers[0], flat_q, start, max(width, nearest + 1))[0]
        row, column = np.nonzero(place >= 0)
        place = place[row, column]
        score = np.einsum("ij,ij->i", q[row], self.exact[place])
        other = self.ids[place] != own[row]
        row, place, score = row[other], place[other], score[other]
        order = np.lexsort((self.ids[place], -score, row))
        row, place, score = row[order], place[order], score[order]
        count = np.bincount(row, minlength=len(q))
        best = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) < nearest
        return own[row[best]], self.ids[place[best]], score[best]


GROUP = ["space", "shard", "part"]


def search(graphs: DataFrame, vectors: DataFrame, queries: Column, nearest: int = NEAREST, width: int = WIDTH, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows of ``graphs`` for the rows of ``vectors`` that ``queries`` marks.

    Nearness is the inner product of the original vectors in double precision; ties go to the
    smaller id; a query's own id is no candidate.  The queries of a space stream past each of its shards, in parts of
    about ``query_rows``; a shard moves once per part.  The shards' best are merged by rank.  Unusable
    vectors neither ask nor answer; repeated rows ask once; an empty table gives no rows; other columns are ignored.
    """
    asking = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & queries).select(
        F.size("embedding").alias("space"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")
    )
    asking = settled(asking.distinct(), "ann-queries")
    parts = asking.groupBy("space").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("parts"))
    shards = graphs.select("space", "shard").distinct()
    part = F.pmod(F.xxhash64("vec_id", F.lit(19)), F.col("parts")).cast("int")
    asked = asking.join(parts, "space").select("space", part.alias("part"), "vec_id", "vec").join(shards, "space")
    held = graphs.join(parts, "space").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    groups = shards.join(parts, "space").agg(F.sum("parts")).first()[0] or 1

    def run(batches):
        def asked_of(shard, batch):
            names, q = batch.column("vec_id").to_numpy(), matrix(batch.column("vec"))
            for at in range(0, len(names), QUERIES_AT_ONCE):
                found = shard.nearest(names[at : at + QUERIES_AT_ONCE], q[at : at + QUERIES_AT_ONCE], nearest, width)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

        yield from streamed(batches, GROUP, _Shard, asked_of)

    found = past(held, asked, GROUP, "vec_id", int(groups)).mapInArrow(run, "query_id long, vec_id long, score double")
    # ids with several vectors are one candidate: the nearest counts
    single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return single.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= nearest)
