"""Costly steps stand in a plan once, and small files share tasks."""

from pyspark.sql import functions as F

from mailrisk.functions import prep, redact
from mailrisk.functions import text as N
from mailrisk.functions.regex import by_first_letter
from mailrisk.functions.urls import html_links
from mailrisk.operators import tables
from mailrisk.sources.eml import read_eml

MARK = "[@]"


def marks(rows):
    """How often the marked step stands in the optimized plan."""
    return rows._jdf.queryExecution().optimizedPlan().toString().count(MARK)


def test_top_brands_cleans_once(spark):
    mail = spark.createDataFrame([("paypal@amazon",), ("none",), ("ebay",), ("ebay",), (None,)], "t string").repartition(2)
    clean = mail.withColumn("clean", F.regexp_replace("t", MARK, " "))
    found = tables.top_brands(clean.select(N.brand_mentions(F.col("clean")).alias("brands")))
    assert marks(found) == 1
    assert {tuple(r) for r in found.collect()} == {("paypal", 1), ("amazon", 1), ("ebay", 2)}


def test_links_strip_once(spark):
    rows = [('<!-- <a href="http://x/"> --><script>a</script><a href="http://y/">b</a>',), (None,)]
    pages = spark.createDataFrame(rows, "h string").repartition(2)
    links = pages.select(html_links(F.regexp_replace("h", MARK, "")).alias("links"))
    assert marks(links) == 1
    assert sorted(map(str, (r.links for r in links.collect()))) == ["None", "['http://y/']"]


def test_names_searched_plainly_first(spark):
    assert "contains" in str(N.brand_mentions(F.col("clean"), whole_word=True))
    rows = spark.createDataFrame([("going irs",), ("ing, firs",)], "clean string")
    assert [r[0] for r in rows.select(N.brand_mentions(F.col("clean"), whole_word=True)).collect()] == [["irs"], ["ing"]]


def test_phrase_letters_form_a_tree():
    assert by_first_letter([r"\b(?:ya|yes)\b", r"\byet\b"]) == "y(?:a|e(?:s|t))"
    assert by_first_letter([r"\b(?:no\s)?(?:a|b)\b"]).startswith("a|b|no")


def test_texts_without_numbers(spark):
    rows = spark.createDataFrame([("call 555 1234",), ("in 123",), (None,)], "t string")
    assert [r[0] for r in rows.select(redact.find_phones(F.col("t"))).collect()] == [["555 1234"], [], None]
    assert "RLIKE" in str(redact.find_phones(F.col("t"))).upper()
    assert [r[0] for r in rows.select(prep.clean_text(F.col("t"))).collect()] == ["call 555 1234", "in 123", None]


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.eml").write_text(f"From: a{i}@b.c\n\nbody {i}\n")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "1m")
    try:
        mails = read_eml(spark, str(tmp_path))
        assert mails.rdd.getNumPartitions() < 200
        assert {r.sender for r in mails.collect()} == {f"a{i}@b.c" for i in range(200)}
    finally:
        spark.conf.set(size, before)
