"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailrisk.llm.shared import WORD, matched, settled

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
GROUP_ROWS = 20_000
SEED = 7


def small_hash(text: Column) -> Column:
    """The first 32 bits of md5: a hash that every SQL engine has."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``: shares by weight, capped.

    Weights are dealt to sources in code point order, null last, and repeat.  A source
    stops at ``most`` times its size and what it leaves is shared anew by weight.  The end of
    that sharing is one level: sources whose cap by weight lies below it stop there, the
    others get their weight times the level.  It is found in one pass over the sources
    in the order of cap by weight.  The windows here run over one row per source, in one task: a million sources are
    some 50 MB; sources are names of collections, so there are far fewer.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    dealt = F.element_at(
        F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    ).cast("double")
    cap = F.col("source_size") * F.lit(most)
    ranked = sources.select("source", "source_size", dealt.alias("w"), cap.alias("cap"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    summed = ranked.select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(share)).alias("all"),
        F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)).alias("w_before"),
        F.sum("w").over(whole).alias("w_all"),
    )
    # were every earlier source at its cap, the rest would share at this level
    level = (F.col("all") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    leveled = summed.withColumn("free", F.when(F.col("cap") > level * F.col("w"), level))
    found = leveled.withColumn("level", F.max("free").over(whole))
    return found.select(
        "source",
        "source_size",
        F.when(F.col("level").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("level") * F.col("w")))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
    group_rows: int = GROUP_ROWS,
    passing: tuple[str, ...] = (),
) -> DataFrame:
    """Copies each document gets: ``doc_id, size, source_size, target, copies, taken``.

    Size is the number of words; null texts have none.  Every document of a source expects
    target / source size copies.  Documents are lined up by size, so that copies fall on
    short and long ones alike, their expectations are summed up, one offset per source is
    added, and a document is emitted once for each whole number its stretch crosses: at
    most ``ceil(most)`` times.  The offset is a hash of source and seed: reruns agree.

    The line is never one task's: places are counted by (source, size), groups of more
    than ``group_rows`` rows are cut further by a hash of the id, and windows only rank rows
    in such a piece.  Equal rows may swap places, which changes nothing.  Null ids and sources
    are values like others; an empty table gives no rows; ``passing`` names further columns to keep.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *passing)
    tie = F.xxhash64("doc_id", "source", "size", *passing)
    sized = settled(sized.withColumn("_tie", tie), "mix-sizes")
    per_size = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    per_size = per_size.select(
        "*", F.greatest(F.lit(1), F.ceil(F.col("n") / group_rows)).cast("long").alias("cuts")
    )
    per_size = settled(per_size, "mix-counts")
    by_source = per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    target = targets(by_source, weights, share, most)

    cut = matched(sized, per_size.select("source", "size", "cuts"), "source", "size").select(
        *sized.columns, F.pmod(small_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("cuts")).alias("cut")
    )
    pieces = cut.groupBy("source", "size", "cut").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("source").orderBy("size", "cut").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("*", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = small_hash(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))) / F.lit(float(1 << 32))
    pieces = matched(pieces, target, "source").select(
        "source", "size", "cut", "before", "source_size", "target", rate.alias("rate"), offset.alias("offset")
    )
    place = Window.partitionBy("source", "size", "cut").orderBy("doc_id", "_tie")
    ranked = cut.select("*", F.row_number().over(place).alias("place"))
    placed = matched(ranked, pieces, "source", "size", "cut")
    end = F.col("before") + F.col("place")
    crossed = F.floor(end * F.col("rate") + F.col("offset")) - F.floor(
        (end - 1) * F.col("rate") + F.col("offset")
    )
    # the bound is exact; rounding in the product could cross one more
    copies = F.least(crossed, F.ceil(F.lit(most)).cast("long"))
    return placed.select(
        "doc_id",
        F.col("source"),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        *passing,
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    rows = docs.select("doc_id", "source", "text", F.struct("*").alias("row"))
    copies = mix(rows, passing=("row",), **options)
    return copies.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select("row.*")
