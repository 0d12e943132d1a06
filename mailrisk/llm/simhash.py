"""SimHash near-duplicates: one-wildcard variants of three segments, equal keys, verified."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.components import components, roots
from mailrisk.llm.shared import settled, small, with_fields

WORDS = 4
SEED = 42
BITS = 4
# (first bit, width): four differing bits leave one of three segments with at most one of them
SEGMENTS = ((0, 21), (21, 21), (42, 22))
# rows of one variant that a task compares at once; greater buckets are cut into pairs of blocks
BLOCK = 8192
FEW = 32


def shingles(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of all runs of ``words`` words, repeated ones too; of the whole text if it has fewer."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space
    if not found:
        return np.empty(0, "<u8")
    line = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        length = np.fromiter(map(len, found), np.int64, len(found))
        end = np.cumsum(length + 1) - 1
        first, last = (end - length)[: 1 - words].tolist(), end[words - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[i:j], seed) for i, j in zip(first, last)]
    return np.array(hashes, "<u8")


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED, block: int = 1 << 15) -> int:
    """64 bits; bit i is set if more than half of the shingle hashes have it.  0 without words."""
    every = shingles(text, words, seed)
    if not len(every):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(every), block):
        part = every[at : at + block]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(every), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, passing: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (a signed long) of every row; null, empty and wordless texts have 0.

    ``passing`` names further columns to keep.
    """

    def run(batches):
        for batch in small(batches):
            fps = [fingerprint(t.as_py(), words, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(np.array(fps, np.uint64).view(np.int64))],
                ["doc_id", *passing, "fp"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text", *passing)
    return rows.mapInArrow(run, with_fields(rows.drop("text"), ("fp", "long")))


def variants(fps: DataFrame) -> DataFrame:
    """``key, fp``: each segment once for each of its bits, with that bit wiped out.

    Two segments that differ in at most one bit have a variant in common.  The bit's number
    tells the segment, so number and wiped value make the key.
    """
    keys = []
    for first, width in SEGMENTS:
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            wiped = value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            keys.append(wiped.bitwiseOR(F.lit((first + bit) << 22)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def differing(a: np.ndarray, b) -> np.ndarray:
    """Differing bits of signed longs (numpy counts the bits of a negative number's absolute value)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def near(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold the near ones of one bucket together: a tree's edges, not all pairs.

    A member takes along all members near to it that were not taken yet; each of these is then
    compared with those still left.  A dense group is used up by its first members.
    """
    left = np.unique(fps)
    a, b = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = differing(left, x) <= bits
            if hit.any():
                found = left[hit]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                left = left[~hit]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(bits: int, block: int | None):
    """Sorted ``(key, fp)`` to ``(key, a, b)`` links; buckets over ``block`` rows go out as (key, fp, null)."""

    def compare(key, fp):
        found = [np.empty(0, np.int64)] * 2
        begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        size = np.diff(np.append(begin, len(key)))
        large = np.repeat(size > FEW, size)
        few_key, few = key[~large], fp[~large]
        pairs = [found]
        for step in range(1, FEW):
            same = few_key[step:] == few_key[:-step]
            if not same.any():
                break
            x, y = few[step:], few[:-step]
            hit = same & (differing(x, y) <= bits) & (x != y)
            pairs.append([x[hit], y[hit]])
        for at, n in zip(begin[size > FEW], size[size > FEW]):
            pairs.append(near(fp[at : at + n], bits))
        a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        if len(a):
            nodes, low = roots(a, b)
            a, b = nodes[nodes != low], low[nodes != low]
        return a, b

    def out(key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), b], ["key", "a", "b"])

    def run(batches):
        key = fp = np.empty(0, np.int64)
        beyond = None  # the key of a bucket that is being passed on
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if block and len(key) - last > block:
                beyond = key[-1]
            skip = key == beyond if beyond is not None else np.zeros(len(key), bool)
            if skip.any():
                yield out(key[skip], fp[skip], pa.nulls(int(skip.sum()), pa.int64()))
            go = ~skip[:last]
            if go.any():
                a, b = compare(key[:last][go], fp[:last][go])
                yield out(np.zeros(len(a), np.int64), a, pa.array(b))
            kept = ~skip[last:]
            key, fp = key[last:][kept], fp[last:][kept]
        if len(key):
            a, b = compare(key, fp)
            yield out(np.zeros(len(a), np.int64), a, pa.array(b))

    return run


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that differ in at most ``bits`` (4 at most) bits.

    They connect whatever all such pairs would connect.  Buckets over ``block`` rows are cut by a
    hash into blocks, and every pair of blocks is compared by some task.
    """
    if bits > BITS:
        raise ValueError("three segments with one wildcard find up to four differing bits")
    keyed = variants(fps)
    schema = "key long, a long, b long"
    first = settled(
        keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(bits, block), schema), "simhash-links"
    )
    beyond = first.where("b is null").select("key", F.col("a").alias("fp"))
    sizes = beyond.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = beyond.join(sizes, "key").select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    again = (
        met.select(pair.alias("key"), "fp")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_links(bits, None), schema)
    )
    return first.where("b is not null").select("a", "b").union(again.select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, seed: int = SEED, block: int = BLOCK, passing: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp, component_id, root``: the smallest id that links of at most ``bits`` bits reach.

    Every row of ``docs`` gives a row; equal fingerprints are one class and linked.  Rows with null
    ids belong to classes but are never their smallest id.  ``root`` names the group even then.  Other columns are ignored.
    """
    marked = settled(fingerprints(docs, words, seed, passing), "simhash")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    joined = components(links(classes.select("fp"), bits, block))
    group = classes.join(joined, classes["fp"] == joined["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root")
    )
    lowest = group.groupBy("root").agg(F.min("low").alias("component_id"))
    named = group.join(lowest, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "root", *passing)


def without_copies(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest id stays.

    Of equal ids and of groups without an id one row stays, chosen by a hash of the row; of
    rows equal in all columns one stays.
    """
    row = F.struct("*")
    keyed = docs.select("doc_id", "text", row.alias("doc"), F.xxhash64(row).alias("_row"))
    found = near_duplicates(keyed.select("doc_id", "text", "_row"), words, bits, passing=("_row",))
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("_row").alias("_row"), F.first("doc_id").alias("_id"))
    equal = found.groupBy("_row").agg(F.count("*").alias("_equal"))
    stays = settled(first.join(equal, "_row").select("_row", "_id", "_equal"), "simhash-kept").withColumnRenamed("_row", "_kept")
    joined = keyed.join(stays, (F.col("_row") == F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    once = joined.where("_equal = 1").select("doc.*")
    more = joined.where("_equal > 1").dropDuplicates(["_row"]).select("doc.*")
    return once.union(more)
