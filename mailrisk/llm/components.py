"""Connected components of an edge table, by stars, without bringing links to the driver."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.shared import settled

MAX_ROUNDS = 60


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node joined to it) for the edges a-b, by repeated halving of paths."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest(batches):
    """The edges of each batch, replaced by one edge from each node to its smallest partner."""
    for batch in batches:
        if batch.num_rows:
            nodes, low = roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            keep = nodes != low
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(low[keep])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, component)``: each linked node's smallest node.

    Batches are reduced to forests first.  Then large and small stars alternate: every node
    hands its greater partners, later its smaller ones, to the smallest it knows.  A hub's
    minimum is aggregated before the shuffle, and the join that hands it on is one that
    adaptive execution may split.  Nodes without an edge to another node are not returned; loops and nulls are ignored.
    """
    spark = edges.sparkSession
    now = (
        edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .where("a is not null and b is not null and a != b")
        .mapInArrow(_forest, "a long, b long")
        .distinct()
    )
    now = settled(now, "stars")
    last = None
    for _ in range(MAX_ROUNDS):
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).where("a != b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a != b")
            .distinct()
        )
        now = settled(small, "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b"), F.col("b")).distinct()
            )
        last = state
    raise RuntimeError("components did not settle")
