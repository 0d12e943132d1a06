"""Vectors as rows: which are usable, and as arrays in tasks."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """True for vectors with components, all of them finite, and not all zero; never null."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(
        embedding.isNotNull() & F.forall(embedding, number) & F.exists(embedding, lambda x: x != 0), F.lit(False)
    )


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """Equally long lists as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), kind)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    # the largest component first, so that squares neither overflow nor vanish
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


# partitions for each group that is one task's work: hashes seldom put two into one then
SPARSE = 4


def past(index: DataFrame, asking: DataFrame, group: list[str], order: str, groups: int) -> DataFrame:
    """Both tables' rows with ``kind`` 0 and 1, sorted by group, kind and ``order`` within partitions, for `streamed`.

    A group's index is moved once; queries follow it as a stream of any length.
    """
    both = index.withColumn("kind", F.lit(0)).unionByName(asking.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(max(1, SPARSE * groups), *group).sortWithinPartitions(*group, "kind", order)


def streamed(batches: Iterator[pa.RecordBatch], group: list[str], opened: Callable, asked: Callable) -> Iterator[pa.RecordBatch]:
    """Run through sorted rows of `past`: ``opened(key, table)`` gets a group's whole index and returns a state,
    ``asked(state, batch)`` each slice of the group's queries and yields batches.  Groups without an index are passed over.
    """
    key, held, state = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        turns = np.zeros(batch.num_rows, bool)
        turns[0] = True
        for name in (*group, "kind"):
            column = batch.column(name)
            turns[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(turns)
        for start, end in zip(starts, np.append(starts[1:], batch.num_rows)):
            part = batch.slice(start, end - start)
            own = tuple(part.column(name)[0].as_py() for name in group)
            if own != key:
                key, held, state = own, [], None
            if part.column("kind")[0].as_py() == 0:
                held.append(part)
                continue
            if state is None:
                if not held:
                    continue
                state, held = opened(key, pa.Table.from_batches(held)), []
            yield from asked(state, part)
