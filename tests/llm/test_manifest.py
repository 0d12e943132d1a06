import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from mailrisk.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """Root of a list of digests and each one's siblings, level by level."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, above = [], []
        for start in range(0, len(nodes), 8):
            run = nodes[start : start + 8]
            for j, members in enumerate(groups[start : start + 8]):
                for i in members:
                    paths[i].append((run[:j], run[j + 1 :]))
            parents.append(sha(*run))
            above.append([i for members in groups[start : start + 8] for i in members])
        nodes, groups = parents, above
    return nodes[0], paths


def brute(rows):
    def lower(text):
        return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in order:
        leaves = sorted(((r, sha(*map(field, r))) for r in langs[lang]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[lang] = (leaves, *tree([leaf for _, leaf in leaves]))
    root, tops = tree([trees[lang][1] for lang in order]) if order else (None, [])
    found = []
    for lang, top in zip(order, tops):
        leaves, subroot, paths = trees[lang]
        for (row, leaf), path in zip(leaves, paths):
            node, path = leaf, path + top
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                node = sha(*map(field, (*row[:4], lower(row[4]))))
            for before, after in path:
                node = sha(*before, node, *after)
            proof = sha(*[s for before, after in path for s in before + after])
            found.append((row[0], leaf, subroot, root, proof, node, node == root))
    return found


CASES = {
    "empty": [],
    "one": [(1, "a", "en", 3, "ABC")],
    "nulls_ties_repeats": [
        (i % 97 if i % 31 else None, "s", [None, "en", "de", "", "zz"][i % 5 if i % 3 else 1], i, f"Text Ä {i % 50}") for i in range(700)
    ] + [(5, None, None, None, None)] * 20 + [(6, "s", "one more", 1, "É" * 200_000)],
    "many_groups": [(i, "s", f"l{i % 150:03d}", i, None if i % 7 == 0 else "T" * (i % 9)) for i in range(200)],
}


@pytest.mark.parametrize("name", CASES)
def test_manifest_equals_brute_force(spark, name):
    rows = spark.createDataFrame(CASES[name], SCHEMA)
    # columns of names that the operator uses inside change nothing
    rows = rows.withColumns({c: F.lit(1) for c in ("idx", "node", "group", "path", "leaf")})
    got = manifest.documents_manifest(rows.repartition(4)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(CASES[name])))


def test_places_do_not_depend_on_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") % 40).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = manifest.ranked(rows, "g", ["v"], "test").where("g = 'hot'").orderBy("idx").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.idx for r in hot] == list(range(len(hot))) and [r.v for r in hot] == sorted(r.v for r in hot)


def test_only_a_changed_text_breaks_the_proof(spark):
    rows = spark.createDataFrame([(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(100)], SCHEMA)
    for r in manifest.documents_manifest(rows).collect():
        assert r.verified == (r.doc_id % 2 == 0 or zlib.crc32(str(r.doc_id).encode()) % 3 != 0)
