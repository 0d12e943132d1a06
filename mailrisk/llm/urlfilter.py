"""URL rules by Bloom filter cascades: exact membership without joins.

A rule is a host and the start of a path; it fits the host and its subdomains.  A URL's candidate keys are
the ends of its host joined to the starts of its path.  A cascade tells which of them are listed: its first filter holds
the listed keys, the second those keys of the corpus that the first takes for listed, the third the listed keys that the
second takes for the corpus's, and so on until nobody is mistaken.  The corpus's keys are all known, so the answer is
exact for each of them, and a URL is judged where it lies.
"""

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.llm.shared import settled

FIRST_RATE = 0.001  # share of unlisted keys that the first filter lets pass
LATER_RATE = 0.5  # the later filters hold few keys; halves are cheapest there
MOST_BITS = 1 << 25  # of one filter in a plan; longer lists are looked up slice by slice
BLOCK, ALLOW = "block", "allow"


# --- keys --------------------------------------------------------------------
def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; then up to ``?``, ``#`` or the end.

    Both are empty for null and where there is no ``://``.
    """
    after = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    host = F.regexp_extract(after, r"\A[^/?#]*+", 0)
    path = F.regexp_extract(after, r"\A[^/?#]*+([^?#]*+)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The ``(labels of the host, characters of the path)`` that rules have, a few hundred at most in practice.

    Only candidates of these shapes can be listed, so a URL has as many keys however long it is.
    """
    shape = rules.select(_labels(F.col("host")).alias("labels"), F.length("path").alias("chars")).distinct()
    return sorted((r.labels, r.chars) for r in shape.collect())


def candidates(host: Column, path: Column, of_shapes) -> Column:
    """The keys of a URL, ``array<struct<length, host_length, key>>``, longest first; of equal ones the longer host."""
    dots = _labels(host)

    def key(labels, chars):
        tail, head = F.substring_index(host, ".", -labels), F.substring(path, 1, chars)
        row = F.struct(
            (-F.length(tail) - chars).alias("length"), (-F.length(tail)).alias("host_length"), F.concat(tail, head).alias("key")
        )
        return F.when((dots >= labels) & (F.length(path) >= chars), row)

    return F.array_sort(F.array_compact(F.array(*[key(*s) for s in of_shapes])))


# --- filters -----------------------------------------------------------------
@dataclass(frozen=True)
class Filter:
    """A Bloom filter: its words of 64 bits, its size, its number of hashes, and a salt of its own."""

    words: dict[int, int]
    bits: int
    hashes: int
    salt: int

    def table(self) -> Column:
        """The words as an array; Spark folds the text to a literal while planning."""
        text = ",".join(str(self.words.get(i, 0)) for i in range(self.bits // 64))
        return F.split(F.lit(text), ",").cast("array<bigint>")

    def holds(self, key: Column) -> Column:
        table = self.table()
        found = F.lit(True)
        for place in positions(key, self.bits, self.hashes, self.salt):
            word = F.get(table, _word(place))
            found = found & (F.getbit(word, (place % 64).cast("int")) == 1)
        return found


def _word(place: Column) -> Column:
    return F.shiftright(place, 6).cast("int")


def positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    """The bits of a key; two hashes give all of them."""
    one, two = F.xxhash64(key, F.lit(salt)), F.xxhash64(F.lit(salt), key)
    step = F.pmod(two, F.lit(bits - 1)) + 1
    return [F.pmod(F.pmod(one, F.lit(bits)) + step * i, F.lit(bits)) for i in range(hashes)]


def sized(n: int, rate: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hashes of a filter of ``n`` keys at a rate of false hits."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    return -(-bits // 64) * 64, max(1, round(-math.log2(rate)))


def bloom(keys: DataFrame, n: int, rate: float, salt: int) -> Filter:
    """The filter of distinct keys: bits set by one aggregation, ``MOST_BITS / 64`` words at most come to the driver."""
    bits, hashes = sized(n, rate)
    places = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, salt))).alias("place"))
    word = _word(F.col("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    words = places.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("set"))
    return Filter({r.word: r.set for r in words.collect()}, bits, hashes, salt)


# --- cascades ----------------------------------------------------------------
class Cascade:
    """Filters of listed keys and of the corpus's keys mistaken for them, in turn."""

    def __init__(self, filters: list[Filter]):
        self.filters = filters

    def holds(self, key: Column) -> Column:
        """Whether a key of the corpus is listed: the level that first denies it decides."""
        listed = F.lit(len(self.filters) % 2 == 1)
        for level in range(len(self.filters) - 1, -1, -1):
            listed = F.when(~self.filters[level].holds(key), F.lit(level % 2 == 1)).otherwise(listed)
        return listed


def cascade(listed: DataFrame, first: Filter, mistaken: DataFrame, salt: int) -> Cascade:
    """Add levels to ``first``, the filter of ``listed``, until every key is told apart.

    ``mistaken`` are distinct unlisted keys that pass ``first``.  Each level halves one of two finite sets
    of keys, with a new salt, so the loop ends after about ``log2`` of their number.
    """
    filters = [first]
    inside, outside = listed, mistaken
    while True:
        n = outside.count()
        if not n:
            return Cascade(filters)
        filters.append(bloom(outside, n, LATER_RATE, salt + len(filters)))
        inside, outside = outside, settled(inside.where(filters[-1].holds(F.col("key"))), "cascade")


def _slice(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("slice"), key), F.lit(slices))


def judge(rows: DataFrame, rules: DataFrame, url: str = "url", most_bits: int = MOST_BITS, first_rate: float = FIRST_RATE) -> DataFrame:
    """``row`` (a struct of the row's columns) with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path``, ``verdict`` (``block`` or ``allow``).  The longest rule that fits decides,
    of equally long ones that with the longer host; a rule in both lists blocks.  A URL that no rule fits is
    unlisted and allowed, with a null rule.  Null URLs, empty ones and those without ``://`` have empty
    host and path.  Very long URLs are read whole; repeated rows are judged alike; empty tables of rows or rules work;
    columns of any name stay inside ``row``.

    Lists whose first filter would exceed ``most_bits`` are cut into slices by a hash of the key; each slice is
    one pass over the rows with a filter of bounded size, and finds are kept between passes.
    """
    rules = settled(
        rules.select("host", "path", "verdict", F.concat("host", "path").alias("key")).where(F.col("key").isNotNull()).distinct(), "url-rules"
    )
    of_shapes = shapes(rules)
    host, path = host_and_path(F.col(url))
    marked = rows.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    none = F.lit(None).cast("struct<length:int,host_length:int,key:string,verdict:string>")
    if not of_shapes:
        return marked.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(ALLOW).alias("verdict"))
    keyed = marked.withColumn("found", none)
    lists = {v: rules.where(F.col("verdict") == v).select("key").distinct() for v in (BLOCK, ALLOW)}
    longest = max(listed.count() for listed in lists.values())
    slices = -(-sized(longest, first_rate)[0] // most_bits)
    # hashes make slices of nearly, not exactly, equal size
    for part in range(slices):
        mine = {v: listed.where(_slice(F.col("key"), slices) == part) for v, listed in lists.items()} if slices > 1 else lists
        counts = {v: listed.count() for v, listed in mine.items()}
        first = {v: bloom(listed, counts[v], first_rate, 2 * k + 1000 * part) for k, (v, listed) in enumerate(mine.items())}
        wanted = candidates(F.col("host"), F.col("path"), of_shapes)
        if slices > 1:
            wanted = F.filter(wanted, lambda c: _slice(c["key"], slices) == part)
        # one scan finds what the first filters of both lists let pass, aggregated before it is shuffled
        passing = keyed.select(F.explode(wanted).alias("c")).select("c.key").select(
            "key", *[f.holds(F.col("key")).alias(v) for v, f in first.items()]
        )
        passing = settled(passing.where(F.col(BLOCK) | F.col(ALLOW)).distinct(), "url-passing")
        cascades = {
            v: cascade(mine[v], first[v], passing.where(v).select("key").join(mine[v], "key", "left_anti"), 100 * (k + 1) + 10000 * (part + 1))
            for k, v in enumerate(mine)
        }

        def verdict(key):
            return F.when(cascades[BLOCK].holds(key), BLOCK).when(cascades[ALLOW].holds(key), ALLOW)

        hits = F.filter(
            F.transform(wanted, lambda c: F.struct(c["length"].alias("length"), c["host_length"].alias("host_length"), c["key"].alias("key"), verdict(c["key"]).alias("verdict"))),
            lambda c: c["verdict"].isNotNull(),
        )
        best = F.array_min(F.array_compact(F.array(F.col("found"), F.get(hits, F.lit(0)))))
        keyed = keyed.withColumn("found", best)
        if part + 1 < slices:
            keyed = settled(keyed, "url-found")
    return keyed.select(
        "row", "host", "path", F.col("found.key").alias("rule"), F.coalesce("found.verdict", F.lit(ALLOW)).alias("verdict")
    )


# The rules of the registered query.
RULES = (("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW))


def fixed_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")
