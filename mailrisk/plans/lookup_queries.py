"""Queries of operators that join tables of any size, of whole-file sources, and of answers to every message."""

from pyspark.sql import functions as F

from mailrisk.functions import urls as U
from mailrisk.operators import domains, monitor, tables, urls
from mailrisk.plans import four_class
from mailrisk.plans.classify import answers, classify
from mailrisk.plans.queries import digest, joined, message4, time_text, verdict_rows
from mailrisk.plans.views import log_view, mail_view, table
from mailrisk.session import shared_dir
from mailrisk.sources.eml import read_eml
from mailrisk.sources.logs import open_field, read_logs, split_logs
from mailrisk.sources.sinks import write_files

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# rules of every kind, and domains that mails imitate
SUFFIX_RULES = ["com", "tk", "*.org", "!example.org", "example.net", "co.uk"]
IMITATED = ["paypal.com", "hosta.example.org", "acceso-seguro-bank.tk", "bit.lyx", "example.org", "www.example.com"]


def one_column(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@query
def classify_mail_tables(spark, sf_dir):
    """Scoring with suffix and brand tables instead of the built-in lists."""
    suffixes, brands = one_column(spark, SUFFIX_RULES, "suffix"), one_column(spark, IMITATED, "brand")
    return verdict_rows(classify(mail_view(spark, sf_dir), suffixes=suffixes, brands=brands))


@query
def registered_mail_domains(spark, sf_dir):
    """Registrable domain of every distinct domain that mails link to."""
    located = urls.message_urls(mail_view(spark, sf_dir)).select(U.url_domain(F.col("url")).alias("domain")).distinct()
    return domains.registered_domains(located, one_column(spark, SUFFIX_RULES, "suffix"))


@query
def lookalike_hosts(spark, sf_dir):
    """Hosts of pages that look like a site, a host's last three labels; every site is a brand."""
    hosts = table(spark, sf_dir, "pages").select(U.url_domain(F.col("url")).alias("registered")).distinct()
    sites = hosts.select(F.substring_index("registered", ".", -3).alias("brand")).distinct()
    found = domains.similar_brands(hosts, sites)
    return found.select("registered", F.round("similarity", 6).alias("similarity"))


@query
def brand_domain_table(spark, sf_dir):
    """Senders that a table of brand domains vouches for."""
    brands = spark.createDataFrame(tables.BRAND_ROWS, "brand string, domain string")
    return tables.sender_brands(mail_view(spark, sf_dir), brands)


@query
def answered_mail(spark, sf_dir):
    """An answer to every message, accepted or not."""
    return answers(mail_view(spark, sf_dir)).select(
        "message_id", "status", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce("risk_score", F.lit(-1)).alias("risk_score"), F.coalesce(joined("top_reasons"), F.lit("")).alias("top_reasons"),
    )


SKETCH_ERROR = 0.005


@query
def latency_sketch(spark, sf_dir):
    """Sliding quantiles from merged sketches, and whether their ranks are as right as stated."""
    width, slide = "6 hours", "1 hour"
    logs = log_view(spark, sf_dir)
    found = monitor.latency_quantiles(logs, width, slide)
    rows = logs.select(F.window("ts", width, slide)["start"].alias("window_start"), F.col("duration_ms").alias("ms"))
    ranks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    counts = [
        c.alias(name) for q in ranks
        for name, c in ((f"{q}_below", F.count_if(F.col("ms") < F.col(q))), (f"{q}_upto", F.count_if(F.col("ms") <= F.col(q))))
    ]
    n = F.col("n_requests")
    near = [
        ((F.col(f"{q}_below") / n <= rank + SKETCH_ERROR) & (F.col(f"{q}_upto") / n >= rank - SKETCH_ERROR)).alias(f"{q}_near")
        for q, rank in ranks.items()
    ]
    return rows.join(found, "window_start").groupBy("window_start", "n_requests").agg(*counts).select(time_text(), "n_requests", *near)


# --- whole files -----------------------------------------------------------------
def mail_files(spark, sf_dir) -> str:
    """Every accepted mail as a file of its own in the shared folder, its number in the path."""
    lines = F.concat(
        F.col("raw_headers"), F.lit("\n\n"), F.col("text_body"),
        F.repeat(F.lit("\nContent-Disposition: attachment; x"), F.size("attachments")),
    )
    mail = mail_view(spark, sf_dir).where(F.col("text_body") != "")
    path = shared_dir(spark, "mail-files")
    write_files(mail.select("message_id", lines.alias("value")), path)
    return path


def read_mail_files(spark, sf_dir):
    number = F.regexp_extract("path", r"message_id=(\d+)", 1).cast("bigint")
    return read_eml(spark, mail_files(spark, sf_dir), pattern="*.txt").withColumn("message_id", number)


@query
def read_eml_files(spark, sf_dir):
    return read_mail_files(spark, sf_dir).select(
        "message_id", "sender", "subject", digest(F.col("headers")).alias("headers_md5"), digest(F.col("body")).alias("body_md5"), "attachment_count"
    )


FILE_REMARKS = [
    "Clasificación final: malicioso", "Clasificación final: seguro", "Es malicioso", "Presenta riesgos", "Parece un correo seguro",
]


@query
def judge_mail_files(spark, sf_dir):
    """Mail files read, and judged by their reviews; some have two reviews, some none."""
    mails = read_mail_files(spark, sf_dir).withColumn("attachments", F.array_repeat(F.lit("x"), F.col("attachment_count")))
    number = F.col("message_id")
    remarks = F.array(*map(F.lit, FILE_REMARKS))
    answers_ = mails.select(
        number, F.explode(F.sequence(F.lit(0), F.pmod(number, F.lit(3)).cast("int"))).alias("k")
    ).where("message_id % 4 <> 2").select("message_id", F.get(remarks, ((number + F.col("k") * 2) % len(FILE_REMARKS)).cast("int")).alias("response"))
    return four_class.judge(mails, answers_, files=True).select(
        "message_id", "label", "risk_score", F.concat_ws(",", F.col("details")["sender"], F.col("details")["attachments"]).alias("details")
    )


@query
def review_several(spark, sf_dir):
    """Mails with a kind and a stern review; the stern one counts."""
    mail = message4(spark, sf_dir)
    responses = F.explode(F.array(F.lit("VEREDICTO: SPAM"), F.when(F.col("message_id") % 2 == 0, "VEREDICTO: PHISHING").otherwise("VEREDICTO: SEGURO")))
    return four_class.judge(mail, mail.select("message_id", responses.alias("response"))).select("message_id", "label", "risk_score", "analysis")


@query
def read_log_fields(spark, sf_dir):
    """Log lines with keys that the table does not have, read from the lines."""
    logs = log_view(spark, sf_dir)
    line = F.to_json(
        F.struct(
            F.col("ts").alias("timestamp"), "endpoint", F.col("duration_ms").alias("latency_ms"),
            (F.col("duration_ms") <= 2000).alias("within_slo"), F.concat(F.lit("r-"), "event_id").alias("request_id"),
        )
    )
    path = shared_dir(spark, "log-fields")
    logs.select(F.when(F.col("event_id") % 10 == 3, F.left(line, F.lit(30))).otherwise(line).alias("value")).write.text(path)
    good, corrupt = split_logs(read_logs(spark, path, open_fields=True))
    rows = good.select(open_field("request_id", "string").alias("request_id"), open_field("within_slo", "boolean").cast("string").alias("within_slo"))
    return rows.groupBy("within_slo").agg(F.count("*").alias("n"), F.min("request_id").alias("first_id"), F.max("request_id").alias("last_id")).unionByName(
        corrupt.agg(F.lit("corrupt").alias("within_slo"), F.count("*").alias("n"), F.lit("corrupt").alias("first_id"), F.lit("corrupt").alias("last_id"))
    )
