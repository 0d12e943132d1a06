"""Child tables of a message: redactions, hops, brand lookups, attachments."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions import headers as H
from mailrisk.functions.attachments import attachment_points
from mailrisk.functions.common import computed_once
from mailrisk.functions.redact import redaction_entries
from mailrisk.operators.domains import lookup


def redaction_ledger(
    messages: DataFrame, text: str = "text_body", key: str = "message_id"
) -> DataFrame:
    """One row per masked match: ``key, pos, kind, fingerprint``."""
    return messages.select(
        key, F.posexplode(redaction_entries(F.col(text))).alias("pos", "entry")
    ).select(key, "pos", "entry.kind", "entry.fingerprint")


def received_hops(messages: DataFrame, headers: str = "raw_headers") -> DataFrame:
    """One row per routing hop with its anomalies."""
    hops = messages.select(
        "message_id",
        F.posexplode(H.header_fields(F.col(headers))["received"]).alias("hop", "received"),
    )
    return hops.withColumn("anomalies", H.hop_anomalies(F.col("received")))


def sender_domains(messages: DataFrame) -> DataFrame:
    """Distinct sender domains with their numbers of messages."""
    sender = F.lower(
        F.substring_index(H.mailbox(H.header_fields(F.col("raw_headers"))["from_field"])["address"], "@", -1)
    )
    return (
        messages.select(sender.alias("domain"))
        .filter(F.col("domain") != "")
        .groupBy("domain")
        .agg(F.count("*").alias("n_messages"))
    )


def sender_brands(messages: DataFrame, brands: DataFrame | None = None, lengths: list[int] | None = None) -> DataFrame:
    """Per sender domain and brand: does the brand send from that domain?

    Without a table every domain meets each of the few built-in brands.  With ``brands`` (``brand, domain``), of
    any size, only legitimate pairs come out: a domain's ends are taken in the lengths that the table's
    domains have (``lengths``, else read from it; names have 253 characters at most) and joined by equality, an end
    that many domains share over several tasks.
    """
    domains = sender_domains(messages)
    if brands is None:
        brand = F.explode(H.brand_table()).alias("brand", "domains")
        return domains.select("*", brand).select(
            "domain",
            "n_messages",
            "brand",
            F.exists("domains", lambda d: F.col("domain").endswith(d)).alias("legitimate"),
        )
    known = brands.select(F.col("domain").alias("suffix"), "brand").where(F.col("suffix") != "").distinct()
    if lengths is None:
        lengths = sorted(r.n for r in known.select(F.length("suffix").alias("n")).distinct().collect())
    ends = [F.when(F.length("domain") >= n, F.right("domain", F.lit(n))) for n in lengths]
    none = F.array().cast("array<string>")
    tried = domains.select("*", F.explode(F.concat(none, F.array_compact(F.array(*ends))) if ends else none).alias("suffix"))
    return (
        lookup(tried, known, "suffix", ["domain"], how="inner")
        .select("domain", "n_messages", "brand", F.lit(True).alias("legitimate"))
        .distinct()
    )


def attachment_report(messages: DataFrame) -> DataFrame:
    """One row per attachment with its points."""
    return messages.select(
        "message_id", F.posexplode("attachments").alias("pos", "file")
    ).select(
        "message_id", "pos", "file.*", attachment_points(F.col("file")).alias("points")
    )


def attachment_hash(
    files: DataFrame, content: str = "content", key: str = "message_id"
) -> DataFrame:
    """Metadata of attachment contents: ``sha256:`` hash, name, type and size."""
    return files.select(
        key,
        "filename",
        "mime",
        F.octet_length(F.col(content)).cast("bigint").alias("size"),
        F.concat(F.lit("sha256:"), F.sha2(F.col(content), 256)).alias("hash"),
    )


def top_brands(messages: DataFrame, brands: str = "brands") -> DataFrame:
    """Messages per mentioned brand.

    Spark filters empty lists before it explodes, by repeating what makes them; so they are made first.
    """
    return (
        computed_once(messages, [], {"brands": F.col(brands)})
        .select(F.explode("brands").alias("brand"))
        .groupBy("brand")
        .agg(F.count("*").alias("n_messages"))
    )


BRAND_ROWS = [(b, d) for b, ds in rules.BRAND_DOMAINS.items() for d in ds]
