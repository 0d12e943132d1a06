"""Merkle manifest of a dataset: digests of rows, a tree per group, one root, and proofs.

A row's leaf is the SHA-256 of its columns.  The leaves of a group, in their order, are joined eight
by eight, level after level, until one node is left: the group's subroot.  The subroots, in the order of
their groups, are joined in the same way to the root.

Every level is one aggregation: a parent's children are spread into ``FANOUT`` slot columns by conditional
aggregates.  The columns one after the other hash to the parent; without the own column they are a child's
siblings.  Proofs go down the same tables, from the root to the leaves, so no step sees more than a parent.
"""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailrisk.llm.shared import settled

FANOUT = 8
_ROW_BITS = 33  # of monotonically_increasing_id


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def group_key(group: Column) -> Column:
    """A text that is never null and sorts as the group does: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def ranked(rows: DataFrame, group: str, order: list[str], purpose: str) -> DataFrame:
    """Add ``idx``: a row's place from 0 in its group, by ``order``, without a task per group.

    Rows are cut into ranges of all ``(group, order)``; a place is the place within the range plus the
    rows of the group in earlier ranges, one count per range and group.  Equal rows may lie in
    different ranges (``tie``), so copies do not make one task's work either.
    """
    keys = [F.col(group), *[F.asc_nulls_first(c) for c in order]]
    lined = rows.withColumn("tie", F.monotonically_increasing_id())
    lined = lined.repartitionByRange(*keys, F.col("tie")).sortWithinPartitions(*keys, F.col("tie")).drop("tie")
    lined = settled(lined.withColumn("at", F.monotonically_increasing_id()), f"{purpose}-lined")
    part = F.shiftright("at", _ROW_BITS)
    counted = lined.groupBy(group, part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(group, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return (
        lined.withColumn("part", part)
        .join(starts, [group, "part"])
        .withColumn("idx", F.col("at") + F.col("shift"))
        .drop("part", "at", "shift")
    )


def _parents(nodes: DataFrame, child: Column, own_digest) -> DataFrame:
    """``group, idx, s0 .. s7, lone, node`` of each run of eight: the slot pivot.

    ``lone`` marks the only child of a group's only run: that group has one node on this level.
    """
    slot = F.col("idx") % FANOUT
    slots = [F.max(F.when(slot == i, child)).alias(f"s{i}") for i in range(FANOUT)]
    spread = nodes.groupBy("group", F.expr(f"idx div {FANOUT}").alias("idx")).agg(*slots)
    digests = [F.coalesce(own_digest(F.col(f"s{i}")), F.lit("")) for i in range(FANOUT)]
    lone = (F.col("idx") == 0) & F.col("s1").isNull()
    return spread.withColumn("lone", lone).withColumn("node", digest(*digests))


def _children(parents: DataFrame, own_digest) -> DataFrame:
    """One row per child with its ``path``: siblings before and after it, then those of its parents."""

    def others(slots):
        return F.concat(F.lit(""), *[F.coalesce(own_digest(F.col(f"s{i}")), F.lit("")) for i in slots])

    def child(i):
        sides = F.struct(others(range(i)).alias("before"), others(range(i + 1, FANOUT)).alias("after"))
        path = F.concat(F.array(sides), F.col("path"))
        return F.struct(
            (F.col("idx") * FANOUT + i).alias("idx"),
            F.col(f"s{i}").alias("child"),
            F.when(F.col("lone"), F.col("path")).otherwise(path).alias("path"),
        )

    spread = F.explode(F.array(*[child(i) for i in range(FANOUT)])).alias("c")
    return parents.select("group", "tops", spread).where(F.col("c.child").isNotNull()).select("group", "tops", "c.*")


def _is_node(column: Column) -> Column:
    return column


def _is_leaf(column: Column) -> Column:
    return column["leaf"]


def _levels(leaves: DataFrame, purpose: str) -> tuple[list[DataFrame], DataFrame]:
    """The parents of every level, bottom up, and each group's ``group, levels, node``, its last node.

    A lone leaf stays as it is, in the first table; above it only groups with several nodes go on.
    The loop runs once per level: eight rows become one each time.
    """
    sizes = leaves.groupBy("group").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    first = _parents(leaves, F.col("item"), _is_leaf)
    first = first.withColumn("node", F.when(F.col("lone"), F.col("s0.leaf")).otherwise(F.col("node")))
    tables, reach = [settled(first, f"{purpose}-level")], FANOUT
    while reach < most:
        parents = _parents(tables[-1].select("group", "idx", "node"), F.col("node"), _is_node)
        tables.append(settled(parents.where(~F.col("lone")), f"{purpose}-level"))
        reach *= FANOUT
    tops = [t.where(F.col("idx") == 0).select("group", F.lit(k).alias("levels"), "node") for k, t in enumerate(tables, 1)]
    every = tops[0]
    for top in tops[1:]:
        every = every.unionByName(top)
    last = every.groupBy("group").agg(F.max(F.struct("levels", "node")).alias("last"))
    return tables, last.select("group", "last.*")


def _paths(tables: list[DataFrame], heads: DataFrame, purpose: str) -> DataFrame:
    """``item, path, tops`` of every leaf; ``heads`` has ``group, levels, path, tops``: what lies above each group."""
    above = None
    for level in range(len(tables), 0, -1):
        start = heads.where(F.col("levels") == level).select("group", F.lit(0).cast("long").alias("idx"), "path", "tops")
        known = start if above is None else start.unionByName(above)
        spread = _children(tables[level - 1].join(known, ["group", "idx"]), _is_leaf if level == 1 else _is_node)
        if level > 1:
            above = settled(spread.select("group", "idx", "path", "tops"), f"{purpose}-paths")
    return spread.select(F.col("child").alias("item"), "path", "tops")


def _empty_path() -> Column:
    return F.from_json(F.lit("[]"), "array<struct<before:string,after:string>>")


def manifest(rows: DataFrame, group: Column, order: list[Column], fields, tampered=None) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root that a (tampered) row folds to.

    ``fields`` makes the list of hashed columns from a function that maps column names to columns;
    ``tampered`` is ``(condition, {column: changed column})``.  Returns ``ids`` (a struct of the order
    columns) with ``leaf, subroot, root, proof_sha256, folded_root, verified``.

    Nulls hash as ``-``; a null group is a group of its own, first of all; null order columns come first.
    Ties of the order go by leaf, so repeated rows are neighbours and each has its own place.  Empty and very
    long texts hash like others; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    leaf = digest(*[field(c) for c in fields(F.col)])
    changed = leaf
    if tampered is not None:
        condition, replaced = tampered
        other = digest(*[field(c) for c in fields(lambda name: replaced.get(name, F.col(name)))])
        changed = F.when(F.coalesce(condition, F.lit(False)), other)
    names = [f"o{i}" for i in range(len(order))]
    facts = rows.select(
        group_key(group).alias("group"), *[c.alias(n) for c, n in zip(order, names)],
        leaf.alias("leaf"), (F.lit(None).cast("string") if tampered is None else changed).alias("changed"),
    )
    leaves = ranked(facts, "group", [*names, "leaf"], "manifest")
    leaves = settled(leaves.select("group", "idx", F.struct(F.struct(*names).alias("ids"), "leaf", "changed").alias("item")), "manifest-leaves")
    tables, subroots = _levels(leaves, "manifest")

    # the same tree once more, over the subroots in the order of their groups
    heads = ranked(subroots.withColumn("whole", F.lit("")), "whole", ["group"], "manifest-heads")
    of = F.struct(F.struct("group", "levels").alias("ids"), F.col("node").alias("leaf")).alias("item")
    heads = settled(heads.select(F.col("whole").alias("group"), "idx", of), "manifest-subroots")
    head_tables, root = _levels(heads, "manifest-root")
    crown = root.select("group", "levels", _empty_path().alias("path"), F.col("node").alias("tops"))
    above = _paths(head_tables, crown, "manifest-root").select(
        "item.ids.*", "path", F.struct(F.col("item.leaf").alias("subroot"), F.col("tops").alias("root")).alias("tops")
    )
    proven = _paths(tables, settled(above, "manifest-above"), "manifest").withColumnRenamed("item", "child")
    start = F.coalesce(F.col("child.changed"), F.col("child.leaf"))
    folded = F.aggregate("path", start, lambda node, s: digest(s["before"], node, s["after"]))
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""))
    return proven.select(
        F.col("child.ids").alias("ids"), F.col("child.leaf").alias("leaf"), "tops.subroot", "tops.root",
        proof.alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of a documents table: a tree per language in the order of the ids.

    Rows whose id's crc32 is divisible by three are tampered with: A-Z of their text in lower case; rows
    with a null id are not.
    """
    every_third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = manifest(
        docs.select(*COLUMNS), F.col("lang"), [F.col("doc_id")], lambda of: [of(c) for c in COLUMNS],
        (every_third, {"text": lower_ascii(F.col("text"))}),
    )
    return made.select(F.col("ids.o0").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
