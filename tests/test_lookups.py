"""Lookups by domain: hot keys, tables of any size, and plans without bodies."""

import random

import pytest
from pyspark.sql import functions as F

from mailrisk.operators import domains
from mailrisk.operators.tables import sender_brands
from mailrisk.plans.classify import answers, classify
from mailrisk.plans.views import mail_view

from conftest import SF


@pytest.mark.parametrize("task_rows", [10, 1_000_000])
def test_lookup_spreads_hot_keys(spark, task_rows):
    facts = spark.range(500).select(F.when(F.col("id") < 200, "hot").when(F.col("id") < 300, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    dimension = spark.createDataFrame([("hot", 1), ("400", 2), ("nobody", 3)], "k string, v int")
    rows = domains.lookup(facts, dimension, "k", ["id"], task_rows).collect()
    assert len(rows) == 500 == len({r.id for r in rows})
    assert all(r.v == (1 if r.id < 200 else 2 if r.id == 400 else None) for r in rows)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_texts_share_enough_pairs():
    """The bound of the candidate search, on random edits of random texts."""
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("abc.") for _ in range(rng.randint(1, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        b = "".join(b)
        if not b or 1 - levenshtein(a, b) / max(len(a), len(b)) <= 0.7:
            continue
        pairs = [[t[i : i + 2] for i in range(len(t) - 1)] for t in (a, b)]
        common = sum(min(pairs[0].count(p), pairs[1].count(p)) for p in set(pairs[0]))
        assert common >= max(domains.shared_pairs(len(a)), domains.shared_pairs(len(b)))


def test_similar_brands_equal_all_pairs(spark):
    rng = random.Random(1)
    parts = ["pay", "pal", "bank", "shop", "secure", "login", "net", "my", "go", "x"]
    brands = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + rng.choice([".com", ".org", ".tk", ""]) for _ in range(1000)})
    names = set(brands[:50]) | {"a", "ab", "abc", ""}
    while len(names) < 10_000:
        name = list(rng.choice(brands))
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(name) + 1)
            name[at : at + rng.randint(0, 1)] = rng.choice("abcxyz01.-")
        names.add("".join(name))
    left = spark.createDataFrame([(n,) for n in names], "registered string")
    right = spark.createDataFrame([(b,) for b in brands], "brand string")
    found = domains.similar_brands(left, right)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    longest = F.greatest(F.length("registered"), F.length("brand"))
    every = left.crossJoin(F.broadcast(right)).withColumn("similarity", 1.0 - F.levenshtein("registered", "brand") / longest)
    want = every.where("similarity > 0.7").groupBy("registered").agg(F.max("similarity").alias("similarity"))
    got = {r.registered: r.similarity for r in found.collect()}
    assert got == {r.registered: r.similarity for r in want.collect()} and len(got) > 1000


def test_registered_domains_by_table(spark):
    suffixes = spark.createDataFrame([(s,) for s in ["com", "com.ng", "ng", "*.ck", "!www.ck", "a.b.c.d"]], "suffix string")
    cases = {
        "shop.com.ng": "shop.com.ng", "x.shop.com.ng": "shop.com.ng", "com.ng": "com.ng", "a.b.ck": "a.b.ck", "z.a.b.ck": "a.b.ck", "www.ck": "www.ck",
        "x.www.ck": "www.ck", "unknown.zz": "unknown.zz", "a.unknown.zz": "unknown.zz", "x.a.b.c.d": "x.a.b.c.d", "localhost": "localhost", "": "",
        ".".join(["l"] * 2000) + ".com": "l.com",
    }
    rows = spark.createDataFrame([(d,) for d in cases], "domain string")
    assert {r.domain: r.registered for r in domains.registered_domains(rows, suffixes).collect()} == cases


def test_suffix_table_reaches_the_verdict(messages, spark):
    """A lookalike below a suffix that the built-in list does not have."""
    mail = messages({"html": '<a href="https://login.paypa1.com.ng/x">x</a>'}, {"html": '<a href="https://login.paypa1.com.ng/x">x</a>'})
    suffixes = spark.createDataFrame([("com.ng",), ("com",)], "suffix string")
    brands = spark.createDataFrame([("paypal.com.ng",)], "brand string")
    same = mail.withColumn("message_id", F.lit(7).cast("bigint"))
    rows = classify(same, suffixes=suffixes, brands=brands).collect()
    assert [r.message_id for r in rows] == [7, 7]
    assert [r.heuristics.url_findings[0].risk_level for r in rows] == ["high", "high"]
    assert all(f.risk_level != "high" for r in classify(same).collect() for f in r.heuristics.url_findings)


def test_lookups_carry_no_bodies(spark):
    """What is joined are features; mail texts end where the features are written."""
    intel = spark.createDataFrame([("bit.ly", None, 3, None, 200, False)], "domain string, registered_on date, redirects int, final_url string, status int, blacklisted boolean")
    plan = classify(mail_view(spark, SF), intel=intel, as_of="2024-02-01")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan
    for body in ("raw_html", "text_body", "raw_headers", "redacted_text", "clean"):
        assert body not in plan


def test_hot_sender_suffix(spark, messages):
    mail = messages(*[{"headers": f"From: A <a@x{i}.paypal.com>"} for i in range(60)], {"headers": "From: B <b@other.org>"}, {"text": "none"})
    brands = spark.createDataFrame([("paypal", "paypal.com"), ("other", "r.org"), ("long", "z" * 200)], "brand string, domain string")
    got = sorted((r.domain, r.brand, r.n_messages) for r in sender_brands(mail, brands).collect())
    assert got == sorted([(f"x{i}.paypal.com", "paypal", 1) for i in range(60)] + [("other.org", "other", 1)])


def test_every_message_is_answered(messages):
    rows = answers(messages({}, {"text": "Hello there."}, {"text": "x", "attachments": [("a.exe", None, None, None)]})).orderBy("message_id").collect()
    assert [r.status for r in rows][:2] == ["invalid_request", "ok"] and len(rows) == 3
    assert rows[0].label is None and rows[0].reason == "no content" and rows[1].label == "seguro"
