"""Shards of near equal size by histogram sort: count below probes, refine, exchange once."""

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailrisk.llm.shared import settled

SHARDS = 8
TOLERANCE = 0.001
PROBES, ALL_PROBES = 16, 4096
# parts of one shard are sorted by tasks of about this many bytes
PART_BYTES = 32 << 20
PART_ROWS = 200_000
# the boundaries that the driver refines together; beyond it parts grow, and their sorts spill
MOST_PARTS = 256
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _below(probes: np.ndarray) -> Callable:
    """For each batch of ``(key, size)``: bytes and rows between neighbouring probes."""

    def count(batches):
        size = np.zeros(len(probes) + 1, np.int64)
        rows = np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            place = np.searchsorted(probes, batch.column(0).to_numpy(), side="right")
            np.add.at(size, place, batch.column(1).to_numpy())
            rows += np.bincount(place, minlength=len(probes) + 1)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(size[used]), pa.array(rows[used])], ["place", "size", "rows"])

    return count


def histogram(keyed: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe, and in all: one small row per task."""
    size, rows = np.zeros(len(probes) + 1, object), np.zeros(len(probes) + 1, object)
    counted = keyed.select("key", "size").mapInArrow(
        _below(np.array(probes, np.int64)), "place long, size long, rows long"
    )
    for place, s, r in counted.groupBy("place").agg(F.sum("size"), F.sum("rows")).collect():
        size[place], rows[place] = s, r
    return np.cumsum(size), np.cumsum(rows)


def splitters(keyed: DataFrame, parts: int, total: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[int]:
    """``parts - 1`` ascending keys; below the i-th lie about i / parts of all bytes.

    Each wanted boundary keeps an interval of keys.  Every round counts, in one pass over
    ``(key, size)``, the exact bytes below a few probes in every open interval and narrows
    all intervals by all counts.  A boundary is settled when a probe meets the tolerance (a
    share of one part) or its interval is a single key, whose rows stay together.
    """
    want = [total * i / parts for i in range(1, parts)]
    slack = tolerance * total / parts
    low, high = [(LOW, 0)] * len(want), [(HIGH, total)] * len(want)
    found: list[int | None] = [None] * len(want)
    while any(x is None for x in found):
        tried = set()
        # the fewer boundaries are open, the more probes each gets
        per = max(probes, ALL_PROBES // sum(x is None for x in found))
        for i, x in enumerate(found):
            if x is None:
                a, b = low[i][0], high[i][0]
                tried |= {a + (b - a) * j // (per + 1) for j in range(1, per + 1)} - {a}
        known = sorted(tried)
        below = histogram(keyed, known)[0].tolist()
        for i, x in enumerate(found):
            if x is not None:
                continue
            at = bisect_right(below, want[i], hi=len(known))
            if at and known[at - 1] > low[i][0]:
                low[i] = (known[at - 1], below[at - 1])
            if at < len(known) and known[at] < high[i][0]:
                high[i] = (known[at], below[at])
            best = min(low[i], high[i], key=lambda p: abs(p[1] - want[i]))
            if abs(best[1] - want[i]) <= slack or high[i][0] - low[i][0] <= 1:
                found[i] = best[0]
    return sorted(found)


def _part(bounds: list[int]):
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), side="right").astype("int32"))

    return place


def shard(
    rows: DataFrame,
    key: Column,
    size: Column,
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    part_bytes: int = PART_BYTES,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """All columns of ``rows`` with ``shard`` (0 to shards - 1) and a gapless ``slot`` in it.

    ``key`` (a long, null like 0) sorts the rows, equal keys stay in one shard, and shard
    sizes (``size`` per row, null like 0) differ as little as whole keys allow: a key heavier than a shard fills one
    alone.  Columns of rows named ``shard`` or ``slot`` are replaced.  An empty table gives an empty table.

    Keys and sizes are written once and the histogram passes read only those.  Shards are
    made of parts; a part with more than ``part_rows`` rows of few keys is cut by a hash of the row.  The
    rows move once, to their parts, where windows number them; what lies before a part comes from counts.
    """
    spark = rows.sparkSession
    plain = rows.drop("shard", "slot")
    names = plain.columns
    own = plain.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.coalesce(key.cast("long"), F.lit(0)).alias("key"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
    )
    own = settled(own, "shard-rows")
    total, n = own.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not n:
        return plain.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    per_shard = min(MOST_PARTS, max(1, -(-max(total // part_bytes, n // part_rows) // shards)))
    parts = shards * per_shard
    bounds = splitters(own, parts, total, tolerance, PROBES)
    # several boundaries on one heavy key leave parts empty, which is fine
    placed = own.withColumn("part", _part(bounds)(F.col("key")))
    heavy = {r["part"]: -(-r["count"] // part_rows) for r in placed.groupBy("part").count().where(F.col("count") > 2 * part_rows).collect()}
    cut = F.lit(0)
    if heavy:
        cuts = F.element_at(F.create_map(*[F.lit(x) for kv in heavy.items() for x in kv]), F.col("part"))
        cut = F.coalesce(F.pmod(F.xxhash64("row"), cuts), F.lit(0))
    placed = placed.withColumn("cut", cut.cast("int"))
    counts = placed.groupBy("part", "cut").count().collect()
    start, before = [], {}
    for r in sorted(counts, key=lambda r: (r["part"], r["cut"])):
        s = r["part"] // per_shard
        start.append((r["part"], r["cut"], s, before.get(s, 0)))
        before[s] = before.get(s, 0) + r["count"]
    starts = spark.createDataFrame(start, "part int, cut int, shard int, start long")
    line = Window.partitionBy("part", "cut").orderBy("key", F.xxhash64("row"))
    ranked = placed.select("*", F.row_number().over(line).alias("place"))
    return ranked.join(starts, ["part", "cut"]).select(
        *[F.col(f"row.`{c}`").alias(c) for c in names], "shard", (F.col("start") + F.col("place") - 1).alias("slot")
    )
