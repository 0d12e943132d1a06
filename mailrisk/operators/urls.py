"""URL tables: one row per (message, position), lookups, scores per message."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.functions import urls as U
from mailrisk.functions.common import computed_once, let
from mailrisk.operators.domains import TASK_ROWS, domain_dimension, lookup, registered_domains
from mailrisk.session import settled


def message_urls(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct URLs of a message in order of appearance, all or the first ``limit``."""
    return messages.select(
        "message_id",
        F.posexplode(
            U.all_links(F.col("raw_html"), F.col("text_body"), limit)
        ).alias("pos", "url"),
    )


def domain_intel(urls: DataFrame, intel: DataFrame, as_of, task_rows: int = TASK_ROWS) -> DataFrame:
    """Attach what is known about a URL's domain, and its age on ``as_of``.

    ``intel`` has one row per domain (see ``schemas.DOMAIN_INTEL``).  Domains with more than ``task_rows`` URLs
    are spread over several tasks.
    """
    known = intel.select(
        "domain",
        F.struct(*[c for c in intel.columns if c != "domain"]).alias("intel"),
    )
    located = urls.withColumn("domain", U.url_domain(F.col("url")))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("intel.registered_on"))
    joined = lookup(located, known, "domain", ["message_id", "pos"], task_rows)
    return joined.withColumn("age_days", age)


def url_analysis(urls: DataFrame, intel: DataFrame | None = None, as_of=None) -> DataFrame:
    """Finding (null when clean) and metadata of every URL row."""
    if intel is None:
        rows, redirects, age, known = urls, None, None, None
    else:
        rows = domain_intel(urls, intel, as_of)
        redirects, age, known = F.col("intel.redirects"), F.col("age_days"), F.col("intel")
    return (
        computed_once(rows, rows.columns, {"facts": U.url_facts(F.col("url"))})
        .withColumn("reasons", U.url_reasons(F.col("facts"), redirects, age))
        .select(
            *urls.columns,
            U.url_finding(F.col("facts"), F.col("reasons")).alias("finding"),
            U.url_metadata(F.col("facts"), known, age).alias("metadata"),
        )
    )


def url_findings(urls: DataFrame, intel: DataFrame | None = None, as_of=None) -> DataFrame:
    """Only the URLs with a reason: ``message_id, pos, url, reason, risk_level``."""
    return (
        url_analysis(urls, intel, as_of)
        .filter(F.col("finding").isNotNull())
        .select("message_id", "pos", "finding.*")
    )


def url_metadata(urls: DataFrame, intel: DataFrame | None = None, as_of=None) -> DataFrame:
    return url_analysis(urls, intel, as_of).select("message_id", "pos", "metadata.*")


def url_score(findings: DataFrame) -> DataFrame:
    """Score per message from a findings table; messages without one are absent."""
    return (
        findings.groupBy("message_id")
        .agg(
            F.sum(U.level_points(F.col("risk_level"))).alias("points"),
            F.count("*").alias("n_findings"),
        )
        .select(
            "message_id",
            "n_findings",
            U.total_url_score(F.col("points"), F.col("n_findings")).alias("url_score"),
        )
    )


def analysed_urls(
    rows: DataFrame, intel: DataFrame | None = None, as_of=None, suffixes: DataFrame | None = None, brands: DataFrame | None = None
) -> DataFrame:
    """Replace ``urls`` by ``analysed`` as ``functions.urls.analyse_urls``, with lookups by domain.

    Rows must be free of bodies: they are written once, with a number each, to the shared folder.  Only thin
    ``(row, pos, domain)`` facts travel; distinct domains are looked up once, and each row gets the
    answers to its URLs as one array.  Rows are told apart by their number, so equal message ids stay apart.
    """
    numbered = settled(rows.withColumn("row_id", F.monotonically_increasing_id()), "features")
    located = numbered.select("row_id", F.posexplode("urls").alias("pos", "url")).select(
        "row_id", "pos", U.url_domain(F.col("url")).alias("domain")
    )
    dimension = domain_dimension(located.select("domain"), intel, as_of, suffixes, brands)
    if intel is None:
        dimension = dimension.withColumns({"intel": F.lit(None).cast("struct<redirects:int>"), "age_days": F.lit(None).cast("int")})
    known = F.struct("pos", "similarity", "intel", "age_days")
    answers = lookup(located, dimension, "domain", ["row_id", "pos"]).groupBy("row_id").agg(
        F.array_sort(F.collect_list(known)).alias("known")
    )

    def judged(url, answer):
        def found(facts):
            reasons = U.url_reasons(facts, answer["intel"]["redirects"], answer["age_days"])
            metadata = U.url_metadata(facts, answer["intel"] if intel is not None else None, answer["age_days"])
            return F.struct(let(reasons, lambda r: U.url_finding(facts, r)).alias("finding"), metadata.alias("metadata"))

        return let(U.url_facts(url, similarity=answer["similarity"]), found)

    without = F.array().cast(answers.schema["known"].dataType)
    joined = numbered.join(answers, "row_id", "left").withColumn("known", F.coalesce("known", without))
    return joined.withColumn("analysed", F.zip_with("urls", "known", judged)).drop("row_id", "known", "urls")


def registered_domain(rows: DataFrame, suffixes: DataFrame, key: str = "domain", row_id: tuple[str, ...] = ()) -> DataFrame:
    """Add the registrable domain by a public-suffix table, see ``domains.registered_domains``.

    ``row_id`` names columns that tell the rows of one domain apart.
    """
    distinct = rows.select(F.col(key).alias("domain")).filter(F.col("domain").isNotNull()).distinct()
    found = registered_domains(distinct, suffixes).select(F.col("domain").alias(key), F.col("registered").alias("registered_domain"))
    return lookup(rows, found, key, list(row_id or rows.columns))
