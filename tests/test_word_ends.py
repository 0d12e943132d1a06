"""Whole texts are searched once for all names, and by word for addresses, with the results of one search each."""

import random
import re

from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions import redact
from mailrisk.functions import text as N
from mailrisk.functions import urls as U
from mailrisk.functions.regex import rare_end, rare_ends


def test_names_and_words_by_their_rare_ends(spark):
    rng = random.Random(11)
    cut = [w[a:] for w in N._ANYWHERE for a in range(3)] + [w[:-a] for w in N._ANYWHERE for a in (1, 2)]
    texts = [None, "", *N._ANYWHERE, *cut]
    for _ in range(1500):
        parts = [rng.choice([*N._ANYWHERE, *cut, "ñ", "😀", "a"]) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice(["", " ", "y"]).join(parts))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("ends", N.word_ends(F.col("t")))
    t, lines = F.col("t"), F.lit("")
    plain = {w: t.contains(w) for w in N._ANYWHERE}
    scanned = {w: N._contains(t, F.col("ends"), w) for w in N._ANYWHERE}
    both = rows.select("t", *[F.struct(plain[w], scanned[w]) for w in plain]).collect()
    assert all(a == b for row in both for a, b in row[1:])
    signals = [N.signals_of(t, lines).alias("a"), N.signals_of(t, lines, ends=F.col("ends")).alias("b")]
    assert all(row.a == row.b for row in rows.select(*signals).collect())


def test_ends_of_overlapping_words(values):
    assert [rare_end(w) for w in ("paypal", "bank", "ing", "enter")] == ["ypal", "bank", None, None]
    pattern = rare_ends(["bank", "caixabank", "abba", "ing"])
    found = values(lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), ["caixabank", "abbabba xabank"])
    assert found == [["xabank", "bank"], ["bba", "bba", "bank"]]


def test_scoring_searches_names_once(spark):
    shown = str(N.brand_mentions(F.col("t"), ends=F.col("found_ends")))
    assert shown.count("found_ends") == sum(rare_end(n) is not None for n in N._NAMES) > 20


def test_addresses_by_word(values):
    assert "split" in str(redact.find_emails(F.col("t"))).lower()
    rule = re.compile(rules.EMAIL_PATTERN, re.IGNORECASE)
    rng = random.Random(3)
    pieces = ["a", "b.c", "@", "@", "x.com", ".org", " ", "  ", "\n", "\t", "\xa0", "é", "-", "%", "_", "|", ",", "9"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 16))) for _ in range(3000)]
    texts += ["a@b.com c@d.org", " a@b.com", "a@b.com ", "a@b.com\na@b.com", "a@b.com@c.org d@e.fg.", "@ @", "a @b.com", "a@ b.com"]
    assert values(redact.find_emails, [*texts, None]) == [rule.findall(t) for t in texts] + [[]]


def test_accounts_by_two_letters(values):
    assert "[cuú]" in redact.ACCOUNT
    rule = re.compile(rules.ACCOUNT_PATTERN, re.IGNORECASE)
    texts = [f"{a}{w}{b}123456" for w in ("account", "ACCOUNT", "Cuenta", "número", "NÚMERO", "Number", "nu", "cc") for a in ("", "x", "é ", "-") for b in ("", " ", "#: ", "x")]
    assert values(redact.find_accounts, texts) == [rule.findall(t) for t in texts]


def test_brands_by_length(values):
    for n in range(1, 40):
        low, high = U._near_lengths(n)
        assert [m for m in range(200) if abs(m - n) < 0.3 * max(m, n)] == list(range(low, high + 1))
    # a length is taken once, not once or more for every brand
    assert str(U.brand_similarity(F.col("registered_name"))).count("length(registered_name)") == 1
    names = ["paypal.com", "paypa1.com", "paypal.comxxx", "paypal.comxxxxx", "", None, "ebay.co", "é" * 12]
    got = values(lambda r: F.struct(U.brand_similarity(r).alias("a"), U.brand_similarity(r, True).alias("b")), names)
    assert [r.a for r in got] == [1.0, 0.9, 1 - 3 / 13, None, None, None, 1 - 1 / 8, None]
    assert [r.b for r in got] == [None, 0.9, 1 - 3 / 13, None, None, None, 1 - 1 / 8, None]
