"""Licences, the pipeline and the entry."""

import math
import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from mailrisk.llm import licenses, queries, simhash

SMALL = "/root/testdata/sf0.001"


def test_licences(spark):
    mit, apache = "Released under the MIT License.", "licensed under the APACHE license, version 2.0"
    files = [
        ("a", "src/LICENSE", f"{mit}\n{'words ' * 50}"), ("b", "src/x.txt", "nothing here"), ("c", "src/deep/er/y.txt", None),
        ("d", "src/deep/COPYING", apache), ("e", "src/deep/er/z.txt", f"code\n{apache}\nmore"), ("f", "other/w.txt", ""),
        ("g", None, "x"), ("h", "src/deep/LICENSE.md", "no licence text, only words"), ("i", "srcs/q.txt", "y"), ("j", "top.txt", "z"),
        ("b", "src/x.txt", "nothing here"), (None, "src/n.txt", "q"), ("k", "long/LICENSE", "the license of a very long line " * 30 + mit),
    ]
    table = spark.createDataFrame([(*f, "c", 1.0) for f in files], "file_id string, path string, text string, licence string, score double")
    got = sorted((str(r.file_id), r.licence, r.origin) for r in licenses.scan(table).collect())
    assert got == sorted([
        ("a", "MIT", "own"), ("b", "MIT", "inherited"), ("b", "MIT", "inherited"), ("c", "Apache-2.0", "inherited"), ("d", "Apache-2.0", "own"),
        ("e", "Apache-2.0", "own"), ("f", None, None), ("g", None, None), ("h", "Apache-2.0", "inherited"), ("i", None, None), ("j", None, None),
        ("None", "MIT", "inherited"), ("k", "MIT", "own"),
    ])
    assert licenses.scan(table.limit(0)).count() == 0


def test_parts_out_of_reach_are_below_the_threshold(spark):
    """What is left out before words are counted could not have come near; random mixtures of templates and other words."""
    draw = random.Random(5)
    known = licenses.bags()
    vocabulary = sorted({w for _, bag in known for w in bag})
    idf = {w: 1 + 9 * draw.random() for w in vocabulary}
    rare, parts = 11.0, []
    for _ in range(1500):
        words = [w for w in draw.choice(known)[1].elements() if draw.random() < 0.95] * draw.choice([1, 1, 3])
        words += [f"z{draw.randrange(draw.choice([2, 400]))}" for _ in range(draw.choice([0, 1, 3, 10, 100]))] + draw.choices(vocabulary, k=draw.choice([0, 2, 20]))
        parts.append(words or ["z"])
    table = spark.createDataFrame(list(enumerate(parts)), "i int, words array<string>")
    kept = {r.i for r in table.where(licenses.reachable(F.col("words"), known, idf, rare, 0.8)).select("i").collect()}
    near = set()
    for i, words in enumerate(parts):
        own = {w: n * idf.get(w, rare) for w, n in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in own.values()))
        for _, bag in known:
            other = {w: n * idf[w] for w, n in bag.items()}
            cosine = sum(x * other.get(w, 0) for w, x in own.items()) / norm / math.sqrt(sum(x * x for x in other.values()))
            if cosine >= 0.8:
                near.add(i)
    assert near <= kept and len(near) > 100 and len(kept) < len(parts)


BSD = """Copyright (c) 2020, Someone

 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 *
 * 1. Redistributions of source code must retain the above copyright
 * notice, this list of conditions and the following disclaimer."""
ISC = """Permission to use, copy, modify, and/or distribute this
software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission
notice appear in all copies."""
MIT = """// Permission is hereby granted, free of charge, to any person obtaining
// a copy of this software and associated documentation files (the
// "Software"), to deal in the Software without restriction, including
// without limitation the rights to use, copy, modify, merge, publish,
// distribute, sublicense, and/or sell copies of the Software, and to
// permit persons to whom the Software is furnished to do so, subject to
// the following conditions:"""
APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions. ordinary words of a long agreement follow here"""
GPL = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Someone
 Everyone is permitted to copy, and so on for many pages"""
NOTICES = {
    "bsd": (BSD, "BSD-3-Clause"), "isc": (ISC, "ISC"), "mit": (MIT, "MIT"), "apache": (APACHE, "Apache-2.0"), "gpl": (GPL, "GPL-3.0"),
    "long": ("some words before it Released under the MIT License. and words after it without any stop " + "plain " * 40, "MIT"),
    "talk": ("We talked about the license of a car and the version of a story, under the public bridge.\n" * 5, None),
    "huge": ("word " * 200_000 + "\nLicensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
}


def test_wrapped_headers_and_heads_of_licence_files(spark):
    rows = [(name, f"{name}/{'LICENSE' if name == 'bsd' else 'x.c'}", text) for name, (text, _) in NOTICES.items()]
    rows += [("below", "bsd/src/deep/y.c", "int main"), *[(f"p{i}", f"plain/{i}", "nothing at all to see\nhere") for i in range(40)]]
    got = {r.file_id: (r.licence, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "file_id string, path string, text string")).collect()}
    assert {name: got[name][0] for name in NOTICES} == {name: licence for name, (_, licence) in NOTICES.items()}
    assert got["below"] == ("BSD-3-Clause", "inherited") and got["p1"] == (None, None)


def test_licences_are_inherited_in_the_query(spark):
    found = queries.op10_licences(spark, "/root/testdata/sf0.01").groupBy("origin").count().collect()
    assert {r.origin for r in found} == {"own", "inherited", None}


def test_lines_without_an_anchor_cannot_be_near():
    known = licenses.bags()
    idf = {w: 1 + (hash(w) % 7) for _, bag in known for w in bag}
    chosen = licenses.anchors(known, idf, 0.8)
    for _, bag in known:
        whole = sum((n * idf[w]) ** 2 for w, n in bag.items())
        rest = sum((n * idf[w]) ** 2 for w, n in bag.items() if w not in chosen)
        assert rest < 0.8**2 * whole


def test_stages(spark):
    """Each stage keeps and drops what it should; the columns stay those of documents."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "12 34 !!", None, None, None)], docs.schema)
    now = docs.union(extra).union(docs.limit(2))
    dropped = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SMALL).cache()
        assert after.columns == docs.columns
        dropped[name] = {r.doc_id for r in now.join(after.select("doc_id").distinct(), "doc_id", "left_anti").collect()}
        if name == "quality":
            labels = spark.read.parquet(f"{SMALL}/labels.parquet")
            judged = labels.join(now.select("doc_id").distinct(), "doc_id").withColumn("kept", F.col("doc_id").isin([r.doc_id for r in after.collect()]))
            assert judged.where("quality = 1 and not kept").count() <= 0.03 * judged.where("quality = 1").count()
            assert judged.where("quality = 0 and kept").count() <= 0.1 * judged.where("quality = 0").count()
        if name == "near_duplicates":
            groups = simhash.near_duplicates(now, words=4, bits=4).select("root").distinct().count()
            assert after.count() == groups == after.select("doc_id").distinct().count()
        now = after
    assert dropped["language"] >= {900_001, 900_002} and len(dropped["language"]) < 10
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.QUERIES} and set(queries.QUERIES) < set(names)
    assert "pipeline" in names and set(queries.ORACLES) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as link:
        for name_of in ("documents", "pages", "conversations"):
            link.sql(f"create view {name_of} as select * from '{SMALL}/{name_of}.parquet'")
        want = link.sql(queries.ORACLES[name])
        columns = want.columns
        rows = [tuple(r) for r in want.fetchall()]
    frame = queries.QUERIES[name](spark, SMALL)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in frame.select(*columns).collect()))) == sorted(map(str, rows))
