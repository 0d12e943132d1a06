import random
import re

import pytest
from pyspark.sql import functions as F

from mailrisk.llm import urlfilter

RULES = "host string, path string, verdict string"


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = re.match(r"[^/?#]*([^?#]*)", rest, re.S).group(1)
    fits = [
        (-len(h + p), -len(h), h + p, v != "block", v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = min(fits, default=None)
    return host, path, best and best[2], best[4] if best else "allow"


ODD = [
    None, "", "x", "http://", "http://NET", "http://a.NET/", "https://x.example.net/en/1?q#z", "https://example.com/de/", "://example.com/de/x",
    "http://a.org/fr/://b.net/", "http://anet/", "http://.net/x", "http://net./x", "http://a?b/", "http://a.example.com/de", "http://İ.NET/\n/x",
    "http://" + "a." * 200_000 + "net/" + "q" * 100_000, "http://u@example.com:80/de/", "http://a.net/", "http://a.net/",
]


def urls(seed, hosts):
    pick = random.Random(seed).choice
    return ODD + [
        f"{pick(['http', 'https'])}://{pick(['', 'a.', 'A.b.'])}{pick(hosts)}{pick(['', '/', '/a', '/a/b', '/ab/c/d', '/en/x', '/de/'])}{pick(['', '?x=/', '#/'])}"
        for _ in range(2000)
    ]


HOSTS = ["net", "org", "com", "example.net", "b.example.net", "a.b.c", "x.com", ""]


def check(spark, listed, rules, **options):
    rows = spark.createDataFrame(list(enumerate(listed)), "i long, url string").withColumns({c: F.lit(0) for c in ("row", "host", "path", "rule", "key")})
    judged = urlfilter.judge(rows.repartition(4), spark.createDataFrame(rules, RULES), **options)
    got = {r.row.i: (r.host, r.path, r.rule, r.verdict) for r in judged.collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(listed)}


def test_fixed_rules(spark):
    check(spark, urls(0, HOSTS), list(urlfilter.RULES))


@pytest.mark.parametrize("options", [{"first_rate": 0.9}, {"most_bits": 64}])
def test_weak_filters_and_slices_stay_exact(spark, options):
    pick = random.Random(1).choice
    rules = [(pick(HOSTS), pick(["/", "/a", "/a/", "/ab/c", ""]), pick(["block", "allow"])) for _ in range(12)]
    check(spark, urls(1, HOSTS), rules, **options)


def test_empty_tables(spark):
    check(spark, [], list(urlfilter.RULES))
    check(spark, ODD, [])


def test_cascade_tells_every_key_apart(spark):
    """A filter that holds next to nothing back needs many levels."""
    listed = spark.range(300).select(F.col("id").cast("string").alias("key"))
    others = spark.range(300, 3000).select(F.col("id").cast("string").alias("key"))
    first = urlfilter.bloom(listed, 300, 0.7, 0)
    mistaken = others.where(first.holds(F.col("key")))
    made = urlfilter.cascade(listed, first, mistaken, 1)
    assert len(made.filters) > 3
    assert listed.where(~made.holds(F.col("key"))).count() == 0 and others.where(made.holds(F.col("key"))).count() == 0


def test_no_python_and_no_join_where_urls_are_judged(spark, capsys):
    rows = spark.createDataFrame([(1, "http://a.net/")], "i long, url string")
    urlfilter.judge(rows, urlfilter.fixed_rules(spark)).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
