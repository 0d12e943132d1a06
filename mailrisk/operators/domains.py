"""What is known about a domain, found out once per distinct domain.

Domains repeat: a few hold a large part of all links.  Everything that needs another table, or costs
more than a comparison, is therefore looked up for distinct domains, and links are joined to the result.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.functions import urls as U
from mailrisk.functions.common import let

TASK_ROWS = 1_000_000  # facts of one key that one task joins; more are spread over several
FREQUENT = 1_000  # character pairs whose frequency orders the others; any order is right


def lookup(facts: DataFrame, dimension: DataFrame, key: str, spread_by: list[str], task_rows: int = TASK_ROWS, how: str = "left") -> DataFrame:
    """Join facts to a dimension by equality, safe for hot keys.

    Keys with more than ``task_rows`` facts are spread over as many parts as they need by the ``spread_by``
    columns, and only their dimension rows are copied, once per part.  There are at most as many hot keys as facts
    divided by ``task_rows``.  Spark may broadcast the dimension, copies included, where its size allows.
    """
    counted = facts.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > task_rows)
    hot = counted.where(F.col(key).isNotNull()).select(
        F.col(key).alias("hot_key"), F.ceil(F.col("n") / task_rows).cast("int").alias("parts")
    )
    parts = F.coalesce("parts", F.lit(1))
    spread = F.pmod(F.xxhash64(*spread_by), parts).cast("int")
    copies = F.explode(F.sequence(F.lit(0), parts - 1))
    salted = facts.join(hot, facts[key] == hot["hot_key"], "left").withColumn("part", spread).drop("hot_key", "parts")
    copied = dimension.join(hot, dimension[key] == hot["hot_key"], "left").withColumn("part", copies).drop("hot_key", "parts")
    return salted.join(copied, [key, "part"], how).drop("part")


# --- registrable domains ----------------------------------------------------------
def _labels(domain: Column) -> Column:
    return F.split(F.ltrim(domain, F.lit(".")), r"\.")


def _tail(labels: Column, n) -> Column:
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def registered_domains(domains: DataFrame, suffixes: DataFrame, depths: list[int] | None = None) -> DataFrame:
    """``domain, registered`` of distinct domains by a public-suffix table (column ``suffix``).

    Plain, wildcard (``*.x``) and exception (``!a.x``) rules are supported; the longest wins, exceptions
    before others, and an unknown suffix is one label.  A domain's ends are tried only for the depths that rules have
    (``depths``, else read from the table), so a domain of a thousand labels has as many candidates as one of five.
    """
    rules = suffixes.select("suffix").where(F.col("suffix").isNotNull()).distinct()
    if depths is None:
        depths = sorted(r.n for r in rules.select(F.size(F.split("suffix", r"\.")).alias("n")).distinct().collect())

    # per number of labels: the rule texts that could match, and how long the suffix then is
    def rules_for(labels, n):
        return [
            F.struct(_tail(labels, F.lit(n)).alias("suffix"), F.lit(n).alias("n")),
            F.struct(F.concat(F.lit("*."), _tail(labels, F.lit(n - 1))).alias("suffix"), F.lit(n).alias("n")),
            F.struct(F.concat(F.lit("!"), _tail(labels, F.lit(n))).alias("suffix"), F.lit(n - 1).alias("n")),
        ]

    def candidates(labels):
        found = [F.when(F.size(labels) >= n, r) for n in depths for r in rules_for(labels, n)]
        none = F.array().cast("array<struct<suffix:string,n:int>>")
        return F.concat(none, F.array_compact(F.array(*found))) if found else none

    tried = domains.select("domain", F.explode(let(_labels(F.col("domain")), candidates)).alias("c")).select("domain", "c.*")
    matched = (
        lookup(tried, rules.withColumn("known", F.lit(True)), "suffix", ["domain"], how="inner")
        .groupBy("domain")
        .agg(F.coalesce(F.max(F.when(F.col("suffix").startswith("!"), F.col("n"))), F.max("n")).alias("n"))
    )
    labels = _labels(F.col("domain"))
    size = F.least(F.coalesce("n", F.lit(1)) + 1, F.size(labels))
    return domains.join(matched, "domain", "left").withColumn("registered", _tail(labels, size)).drop("n")


# --- lookalikes --------------------------------------------------------------------
SIMILAR = 0.7


def most_edits(longest: int) -> int:
    """Edits of two texts, the longer one of ``longest`` characters, whose similarity is above 0.7."""
    return max(0, math.ceil((10 - round(SIMILAR * 10)) * longest / 10) - 1)


def shared_pairs(length: int) -> int:
    """Character pairs that a text of ``length`` has in common with every similar text, at least.

    An edit spoils at most two of the longer text's ``longest - 1`` pairs.
    """
    partners = range(length, int(length / SIMILAR) + 2)
    return min(longest - 1 - 2 * most_edits(longest) for longest in partners)


def _pairs(text: Column) -> Column:
    """Pairs of neighbouring characters, each with how often it came before: ``ab0``, ``ab1``."""
    places = F.sequence(F.lit(1), F.length(text) - 1)
    pairs = F.when(F.length(text) > 1, F.transform(places, lambda i: F.substring(text, i, F.lit(2))))

    def numbered(pairs):
        return F.transform(
            pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda q: q == p)).cast("string"))
        )

    return let(F.coalesce(pairs, F.array().cast("array<string>")), numbered)


def _prefix(text: Column, ranks: Column) -> Column:
    """The rarest pairs of a text, so many that similar texts share one of them; the text itself if it has no pair."""
    sized = F.transform(_pairs(text), lambda p: F.struct(F.coalesce(F.try_element_at(ranks, p), F.lit(0)).alias("often"), p.alias("pair")))
    n = F.length(text)
    # the least number over all partners, in a table up to the longest name there can be, a rule beyond
    table = F.array(*[F.lit(max(1, shared_pairs(k))) for k in range(256)])
    shared = F.when(n < 256, F.get(table, n.cast("int"))).otherwise(F.lit(1))
    kept = F.slice(F.array_sort(sized), F.lit(1), F.greatest(n - 1 - shared + 1, F.lit(1)))
    return F.when(n > 1, F.transform(kept, lambda s: s["pair"])).otherwise(F.array(text))


def similar_brands(names: DataFrame, brands: DataFrame) -> DataFrame:
    """``registered, similarity``: the best edit similarity above 0.7 of distinct names to a brand table (column ``brand``).

    Similar texts share one of their rare character pairs, so candidates are found by equality on those; lengths
    too far apart are left out, and what remains is measured.  Names and brands of any number; no all-pairs join.
    """
    known = brands.select("brand").where(F.col("brand") != "").distinct()
    often = known.select(F.explode(_pairs(F.col("brand"))).alias("p")).groupBy("p").count().orderBy(F.desc("count"), "p").limit(FREQUENT)
    ranked = [x for i, r in enumerate(reversed(often.collect()), 1) for x in (F.lit(r.p), F.lit(i))]
    ranks = F.create_map(*ranked) if ranked else F.create_map().cast("map<string,int>")
    left = names.select("registered", F.explode(_prefix(F.col("registered"), ranks)).alias("pair"))
    right = known.select("brand", F.explode(_prefix(F.col("brand"), ranks)).alias("pair"))
    longest = F.greatest(F.length("registered"), F.length("brand"))
    apart = F.abs(F.length("registered") - F.length("brand"))
    candidates = lookup(left, right, "pair", ["registered"], how="inner").where(apart < (1 - SIMILAR) * longest)
    near = candidates.select("registered", "brand").distinct()
    similarity = 1.0 - F.levenshtein("registered", "brand") / longest
    return near.withColumn("similarity", similarity).where(F.col("similarity") > SIMILAR).groupBy("registered").agg(
        F.max("similarity").alias("similarity")
    )


# --- the dimension --------------------------------------------------------------------
def domain_dimension(
    domains: DataFrame, intel: DataFrame | None = None, as_of=None, suffixes: DataFrame | None = None, brands: DataFrame | None = None
) -> DataFrame:
    """``domain, similarity, intel, age_days``, one row per distinct domain.

    ``intel`` has one row per domain (see ``schemas.DOMAIN_INTEL``), ``suffixes`` public-suffix rules, ``brands``
    domains that others imitate.  What is not given comes from the built-in lists, or is null.
    """
    rows = domains.select("domain").where(F.col("domain").isNotNull()).distinct()
    if suffixes is None:
        rows = rows.withColumn("registered", U.registered_domain(F.col("domain")))
    else:
        rows = registered_domains(rows, suffixes)
    if brands is None:
        rows = rows.withColumn("similarity", U.brand_similarity(F.col("registered")))
    else:
        rows = rows.join(similar_brands(rows.select("registered").distinct(), brands), "registered", "left")
    if intel is None:
        return rows.select("domain", "registered", "similarity")
    known = intel.select("domain", F.struct(*[c for c in intel.columns if c != "domain"]).alias("intel"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("intel.registered_on"))
    return rows.join(known, "domain", "left").select("domain", "registered", "similarity", "intel", age.alias("age_days"))
