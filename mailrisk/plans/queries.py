"""Every operator as a query over the provided tables.

Each function takes ``(spark, sf_dir)`` and returns a flat table: arrays joined to
text, times as text, long texts as their MD5, doubles rounded, so that results can
be compared value by value with SQL.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions import headers as H
from mailrisk.functions import prep, redact
from mailrisk.functions import text as N
from mailrisk.functions import urls as U
from mailrisk.functions import verdict as V
from mailrisk.functions.attachments import attachment_score
from mailrisk.functions.common import let, strings
from mailrisk.operators import alerts, evaluate, monitor, service_rules, tables, urls
from mailrisk.operators.alerts import step_seconds
from mailrisk.operators.fuse import (
    apply_policy,
    combine_review,
    error_verdict,
    heuristics,
)
from mailrisk.operators.review import review_requests, score_with_reviewer
from mailrisk.operators.validate import check_verdict, fill_defaults, require_content
from mailrisk.plans import four_class
from mailrisk.plans.classify import classify
from mailrisk.plans.views import gauge_view, log_of, log_view, mail_of, mail_view, table
from mailrisk.session import settled, shared_dir, stateful
from mailrisk.sources.cases import case_messages, read_cases
from mailrisk.sources.eml import parse_eml
from mailrisk.sources.logs import read_logs, split_logs
from mailrisk.sources.messages import (
    extract_mail_fields,
    extract_review_fields,
    read_messages,
    typed_ingest,
)
from mailrisk.sources.sinks import export_metrics, write_verdicts
from mailrisk.streaming import streams
from mailrisk.streaming.stateful import alerts_stream, sliding_stream
from mailrisk.streaming.streams import classify_stream, metrics_stream

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# --- presentation ------------------------------------------------------------
def joined(array, by="|"):
    return F.array_join(array, by)


def digest(text):
    return F.md5(text.cast("binary"))


def rounded(number):
    return F.round(number, 6)


def time_text(ts="window_start"):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)


def accepted_mail(spark, sf_dir) -> DataFrame:
    return require_content(fill_defaults(mail_view(spark, sf_dir)))[0]


def scored_mail(spark, sf_dir) -> DataFrame:
    return heuristics(accepted_mail(spark, sf_dir))


def text_query(step):
    """A query that applies one text function to every accepted message."""

    def run(spark, sf_dir):
        result = step(F.col("text_body"))
        return accepted_mail(spark, sf_dir).select(
            "message_id", digest(result).alias("text_md5"), F.length(result).alias("n_chars")
        )

    return run


def header_details(spark, sf_dir) -> DataFrame:
    fields = H.header_fields(F.col("raw_headers"))
    return (
        accepted_mail(spark, sf_dir)
        .withColumn("fields", fields)
        .withColumn("details", H.header_details(F.col("fields")))
    )


# --- sources and sinks -------------------------------------------------------
@query
def read_messages_json(spark, sf_dir):
    path = shared_dir(spark, "messages")
    mail_view(spark, sf_dir).drop("lang").write.json(path)
    return read_messages(spark, path).select(
        "message_id",
        digest(F.col("text_body")).alias("text_md5"),
        F.size("attachments").alias("n_attachments"),
        F.col("context.user_locale").alias("user_locale"),
        joined("context.trusted_senders").alias("trusted_senders"),
    )


@query
def parse_eml_files(spark, sf_dir):
    mail = accepted_mail(spark, sf_dir)
    lines = F.concat(
        F.col("raw_headers"), F.lit("\n\n"), F.col("text_body"),
        F.repeat(
            F.lit("\nContent-Disposition: attachment; x"), F.size("attachments")
        ),
    )
    files = mail.select("message_id", lines.cast("binary").alias("content"))
    return parse_eml(files).select(
        "message_id",
        "sender",
        "subject",
        digest(F.col("headers")).alias("headers_md5"),
        digest(F.col("body")).alias("body_md5"),
        "attachment_count",
    )


def raw_mail(mail: DataFrame) -> DataFrame:
    """Raw mail with CRLF lines; every other message lacks the blank line."""
    gap = F.when(F.col("message_id") % 2 == 0, "\r\n\r\n").otherwise("\r\n")
    return mail.withColumn(
        "raw",
        F.concat(
            F.replace("raw_headers", F.lit("\n"), F.lit("\r\n")), gap, F.col("text_body")
        ),
    )


@query
def split_raw_message(spark, sf_dir):
    head = prep.split_raw_message(F.col("raw"))
    return raw_mail(mail_view(spark, sf_dir)).select(
        "message_id", digest(head).alias("head_md5"), F.length(head).alias("n_chars")
    )


def page_mail(spark, sf_dir):
    user = F.concat(F.lit("user"), F.col("page_id") % 7, F.lit("@corp"), F.col("page_id") % 3, F.lit(".example"))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("message_id"),
        F.concat(F.lit("From: web@"), F.col("page_id"), F.lit("\r\n\r\n"), F.col("html")).alias("raw"),
        "html",
        F.when(F.col("page_id") % 4 == 0, F.col("url")).alias("plain"),
        F.array().cast("array<struct<filename:string,mime:string,size:bigint,hash:string>>").alias("attachments"),
        user.alias("user_address"),
        F.lit(None).cast("string").alias("user_locale"),
        F.col("url").alias("subject"),
        user.alias("sender"),
        F.lit("Mon, 1 Jan 2024").alias("sent_at"),
    )


@query
def extract_mail_fields_pages(spark, sf_dir):
    return extract_mail_fields(page_mail(spark, sf_dir)).select(
        "message_id",
        "raw_headers",
        digest(F.col("text_body")).alias("text_md5"),
        joined("context.owned_domains").alias("owned_domains"),
        F.col("context.user_locale").alias("user_locale"),
    )


@query
def extract_review_fields_pages(spark, sf_dir):
    return extract_review_fields(page_mail(spark, sf_dir)).select(
        "message_id",
        "email_headers",
        digest(F.col("email_body")).alias("body_md5"),
        "sender",
    )


def labelled(spark, sf_dir) -> DataFrame:
    """Messages of labelled documents with what their label expects."""
    truth = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("message_id"),
        F.when(F.col("toxic") == 1, "phishing").otherwise("seguro").alias("expected_label"),
        F.when(F.col("toxic") == 1, 70).otherwise(20).alias("expected_score"),
    )
    return accepted_mail(spark, sf_dir).join(truth, "message_id")


@query
def read_cases_json(spark, sf_dir):
    case = F.struct(
        F.concat(F.lit("doc "), F.col("message_id")).alias("name"),
        F.col("expected_label").alias("classification"),
        F.col("expected_score"),
        F.struct(
            "raw_headers", "raw_html", "text_body",
            F.col("attachments").alias("attachments_meta"),
            F.col("context").alias("account_context"),
        ).alias("request"),
    )
    path = shared_dir(spark, "cases")
    bad = F.col("expected_label") == "phishing"
    labelled(spark, sf_dir).select(
        F.when(bad, F.array(case)).alias("phishing_examples"),
        F.when(~bad, F.array(case)).alias("legitimate_examples"),
    ).write.json(path)
    cases = read_cases(spark, path, multi_line=False)
    return case_messages(cases).select(
        F.col("message_id").alias("name"), digest(F.col("text_body")).alias("text_md5")
    ).join(cases.select("name", "category", "expected_label", "expected_score"), "name")


def log_lines(spark, sf_dir):
    """Log rows as JSON lines with the service's keys, every tenth cut short."""
    names = {"ts": "timestamp", "endpoint": "path", "status": "status_code", "duration_ms": "latency_ms", "event": "message"}
    kept = [c for c in log_view(spark, sf_dir).columns if c != "event_id"]
    line = F.to_json(F.struct(*[F.col(c).alias(names.get(c, c)) for c in kept]))
    return log_view(spark, sf_dir).select(
        F.when(F.col("event_id") % 10 == 3, F.left(line, F.lit(30))).otherwise(line).alias("value")
    )


@query
def read_logs_lines(spark, sf_dir):
    path = shared_dir(spark, "logs")
    log_lines(spark, sf_dir).write.text(path)
    good, corrupt = split_logs(read_logs(spark, path))
    return (
        good.groupBy("endpoint", "status")
        .agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"))
        .unionByName(
            corrupt.agg(
                F.lit("corrupt").alias("endpoint"),
                F.lit(0).alias("status"),
                F.count("*").alias("n"),
                F.lit(0).cast("bigint").alias("total_ms"),
            )
        )
    )


@query
def write_verdict_table(spark, sf_dir):
    path = shared_dir(spark, "verdicts")
    write_verdicts(classify(mail_view(spark, sf_dir)), path)
    return spark.read.parquet(path).groupBy("label").agg(
        F.count("*").alias("n"),
        F.sum("risk_score").alias("sum_score"),
        F.sum(F.size("top_reasons")).alias("n_reasons"),
    )


@query
def export_metrics_table(spark, sf_dir):
    labels = F.array_sort(
        F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )
    return export_metrics(log_view(spark, sf_dir)).select(
        "metric", joined(labels, ",").alias("labels"), rounded(F.col("value")).alias("value")
    )


# --- validation --------------------------------------------------------------
@query
def require_content_split(spark, sf_dir):
    accepted, rejected = require_content(fill_defaults(mail_view(spark, sf_dir)))
    return (
        accepted.withColumn("reason", F.lit("accepted"))
        .unionByName(rejected)
        .groupBy("reason", "lang")
        .agg(F.count("*").alias("n"))
    )


@query
def typed_ingest_lines(spark, sf_dir):
    mail = mail_view(spark, sf_dir).drop("lang")
    line = F.to_json(F.struct(*mail.columns))
    wrong = F.replace(line, F.lit('"size":2048000'), F.lit('"size":"large"'))
    good, rejected = typed_ingest(mail.select(wrong.alias("value")))
    return good.agg(
        F.lit("accepted").alias("reason"),
        F.count("*").alias("n"),
        F.sum(F.size("attachments")).alias("n_attachments"),
    ).unionByName(
        rejected.groupBy("reason").agg(
            F.count("*").alias("n"), F.lit(0).cast("bigint").alias("n_attachments")
        )
    )


@query
def fill_message_defaults(spark, sf_dir):
    return fill_defaults(mail_view(spark, sf_dir)).select(
        "message_id",
        F.col("context.user_locale").alias("user_locale"),
        F.size("context.trusted_senders").alias("n_trusted"),
        joined("context.owned_domains").alias("owned_domains"),
    )


@query
def check_verdict_rows(spark, sf_dir):
    doc = table(spark, sf_dir, "documents")
    made = doc.select(
        "doc_id",
        F.get(
            strings([*rules.LABELS, "spam", "unknown"]), (F.col("doc_id") % 5).cast("int")
        ).alias("label"),
        (F.col("n_chars") % 130).cast("int").alias("risk_score"),
        F.array_repeat(F.lit("r"), (F.col("doc_id") % 6).cast("int")).alias("top_reasons"),
        F.array_repeat(F.lit("a"), (F.col("doc_id") % 4).cast("int")).alias("actions"),
        F.col("text").alias("summary"),
    )
    return check_verdict(made).select(
        "doc_id", "label_ok", "score_ok", "reasons_ok", "actions_ok", "summary_ok", "valid"
    )


# --- text preparation --------------------------------------------------------
@query
def html_to_text(spark, sf_dir):
    text = prep.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", digest(text).alias("text_md5"), F.length(text).alias("n_chars")
    )


@query
def clean_text(spark, sf_dir):
    text = prep.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", digest(text).alias("text_md5"), F.length(text).alias("n_chars")
    )


@query
def truncate_fields(spark, sf_dir):
    words = F.split("text_body", " ")
    cut = prep.truncate_fields(
        F.col("raw_headers"), F.col("text_body"), words, words, F.col("context.owned_domains")
    )
    return accepted_mail(spark, sf_dir).select(
        "message_id",
        digest(cut["headers_raw"]).alias("headers_md5"),
        digest(cut["text_body"]).alias("text_md5"),
        joined(cut["html_snippets"], " ").alias("snippets"),
        joined(cut["url_metadata"], " ").alias("metadata"),
        joined(cut["owned_domains"]).alias("owned_domains"),
    )


# --- redaction ---------------------------------------------------------------
@query
def mask_email(spark, sf_dir):
    address = F.concat(
        F.substring(F.lower("c_name"), 1, (F.col("c_custkey") % 18).cast("int")),
        F.when(F.col("c_custkey") % 11 == 0, "").otherwise("@"),
        F.lower("c_mktsegment"),
        F.lit(".com"),
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey", redact.mask_email(address).alias("masked")
    )


@query
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", redact.fingerprint(F.col("text")).alias("fingerprint")
    )


for _name in (
    "redact_emails", "redact_phones", "redact_accounts", "redact_cards",
    "redact_text", "redact_placeholder",
):
    QUERIES[_name] = text_query(getattr(redact, _name))


@query
def redaction_ledger(spark, sf_dir):
    return tables.redaction_ledger(accepted_mail(spark, sf_dir)).select(
        "message_id", "pos", "kind", "fingerprint"
    )


@query
def redact_header_ips(spark, sf_dir):
    return accepted_mail(spark, sf_dir).select(
        "message_id", redact.redact_headers(F.col("raw_headers")).alias("headers")
    )


@query
def safe_snippets(spark, sf_dir):
    pieces = accepted_mail(spark, sf_dir).select(
        "message_id", redact.safe_snippets(F.col("text_body")).alias("s")
    )
    return pieces.select(
        "message_id", F.size("s").alias("n_snippets"), digest(joined("s")).alias("snippets_md5")
    )


# --- headers -----------------------------------------------------------------
@query
def parse_headers(spark, sf_dir):
    parsed = accepted_mail(spark, sf_dir).select(
        "message_id", F.explode(H.parse_headers(F.col("raw_headers"))).alias("name", "values")
    )
    return parsed.select("message_id", "name", joined("values").alias("header_values"))


@query
def spf_status(spark, sf_dir):
    return header_details(spark, sf_dir).select("message_id", "details.spf")


@query
def dkim_status(spark, sf_dir):
    return header_details(spark, sf_dir).select(
        "message_id",
        F.col("details.dkim.status").alias("status"),
        F.coalesce("details.dkim.domain", F.lit("")).alias("domain"),
    )


@query
def dmarc_status(spark, sf_dir):
    return header_details(spark, sf_dir).select(
        "message_id",
        F.col("details.dmarc.status").alias("status"),
        F.coalesce("details.dmarc.policy", F.lit("")).alias("policy"),
    )


def header_flag(name):
    def run(spark, sf_dir):
        found = header_details(spark, sf_dir).select(
            "message_id", H.findings_of(F.col("details")).alias("f")
        )
        return found.select("message_id", F.col(f"f.{name}").alias(name))

    return run


QUERIES["auth_status"] = header_flag("auth")
QUERIES["reply_to_mismatch"] = header_flag("reply_to_mismatch")
QUERIES["display_name_spoof"] = header_flag("display_name_spoof")
QUERIES["punycode_sender"] = header_flag("punycode")


@query
def brand_domain_lookup(spark, sf_dir):
    return tables.sender_brands(mail_view(spark, sf_dir))


@query
def received_anomalies(spark, sf_dir):
    return tables.received_hops(accepted_mail(spark, sf_dir)).select(
        "message_id", "hop", joined("anomalies").alias("anomalies")
    )


@query
def suspicious_received(spark, sf_dir):
    return header_flag("suspicious_received")(spark, sf_dir)


@query
def header_score(spark, sf_dir):
    return accepted_mail(spark, sf_dir).select(
        "message_id",
        H.header_score(H.header_findings(F.col("raw_headers"))).alias("header_score"),
    )


# --- URLs --------------------------------------------------------------------
@query
def html_links(spark, sf_dir):
    return accepted_mail(spark, sf_dir).select(
        "message_id", F.posexplode(U.html_links(F.col("raw_html"))).alias("pos", "url")
    )


@query
def html_links_injected(spark, sf_dir):
    """Pages with an encoded link and a misleading title put in, and links that only look like some."""
    number = F.col("page_id").cast("string")
    page = F.concat(
        F.col("html"),
        F.lit('<a href="https&colon;&#x2f;&#47;x'), number, F.lit('.example&sol;&#104;?a=1&amp;b=2">x</a>'),
        F.lit('<!-- <a href="http://comment.example"> --><script>var a = "<a href=\'http://script.example\'>";</script>'),
        F.lit('<img title="see href=https://wrong.example now" src=https://right.example/'), number, F.lit(">"),
    )
    return table(spark, sf_dir, "pages").select(
        F.col("page_id"), F.posexplode(U.html_links(page)).alias("pos", "url")
    )


@query
def text_links(spark, sf_dir):
    return accepted_mail(spark, sf_dir).select(
        "message_id", F.posexplode(U.text_links(F.col("text_body"))).alias("pos", "url")
    )


@query
def message_urls(spark, sf_dir):
    return urls.message_urls(accepted_mail(spark, sf_dir))


def page_urls(spark, sf_dir):
    """Page URLs and mail URLs as one URL table."""
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("origin"), F.col("page_id").alias("message_id"),
        F.lit(0).alias("pos"), "url",
    )
    mail = urls.message_urls(accepted_mail(spark, sf_dir)).select(
        F.lit("mail").alias("origin"), "message_id", "pos", "url"
    )
    return pages.unionByName(mail)


def url_check(name, check):
    def run(spark, sf_dir):
        rows = page_urls(spark, sf_dir)
        return rows.select("origin", "message_id", "pos", check(F.col("url")).alias(name))

    return run


QUERIES["url_domain"] = url_check("domain", U.url_domain)
QUERIES["suspicious_pattern"] = url_check("suspicious", U.suspicious_pattern)
QUERIES["ip_host"] = url_check("is_ip", U.ip_host)
QUERIES["shortener"] = url_check("is_shortener", lambda u: U.shortener(U.url_domain(u)))
QUERIES["no_https"] = url_check("no_https", lambda u: ~U.uses_https(u))
QUERIES["brand_similarity"] = url_check(
    "similarity",
    lambda u: F.coalesce(
        rounded(
            let(U.registered_domain(U.url_domain(u)), lambda r: U.brand_similarity(r))
        ),
        F.lit(0.0),
    ),
)

SUFFIXES = ["com", "net", "org", "example.net", "*.tk", "!www.tk"]


@query
def registered_domain(spark, sf_dir):
    located = page_urls(spark, sf_dir).withColumn("domain", U.url_domain(F.col("url")))
    suffixes = spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")
    row_id = ("origin", "message_id", "pos")
    return urls.registered_domain(located, suffixes, row_id=row_id).select(
        "origin", "message_id", "pos", "registered_domain"
    )


AS_OF = "2024-02-01"


def intel_of(rows: DataFrame) -> DataFrame:
    """A domain table of the domains seen, but for one suffix nobody knows about.

    Facts follow from the length of the name.
    """
    n = F.length("domain")
    return (
        rows.select(U.url_domain(F.col("url")).alias("domain"))
        .distinct()
        .filter(~F.col("domain").endswith(".org"))
        .select(
            "domain",
            F.date_sub(F.lit(AS_OF).cast("date"), n * 3).alias("registered_on"),
            (n % 5).alias("redirects"),
            F.concat(F.lit("https://"), "domain", F.lit("/end")).alias("final_url"),
            (n % 2 * 100 + 200).alias("status"),
            (n % 7 == 0).alias("blacklisted"),
        )
    )


@query
def domain_intel(spark, sf_dir):
    rows = page_urls(spark, sf_dir)
    return urls.domain_intel(rows, intel_of(rows), AS_OF).select(
        "origin",
        "message_id",
        "pos",
        F.coalesce("age_days", F.lit(-1)).alias("age_days"),
        F.coalesce("intel.redirects", F.lit(-1)).alias("redirects"),
        F.coalesce("intel.blacklisted", F.lit(False)).alias("blacklisted"),
    )


@query
def url_findings(spark, sf_dir):
    return urls.url_findings(urls.message_urls(accepted_mail(spark, sf_dir)))


@query
def url_findings_intel(spark, sf_dir):
    rows = urls.message_urls(accepted_mail(spark, sf_dir))
    return urls.url_findings(rows, intel_of(rows), AS_OF)


@query
def url_metadata(spark, sf_dir):
    rows = urls.message_urls(accepted_mail(spark, sf_dir))
    return urls.url_metadata(rows).select(
        "message_id", "pos", "url", "domain", "https", "redirections",
        F.coalesce(rounded(F.col("domain_similarity")), F.lit(0.0)).alias("similarity"),
        "blacklist_hit", "analysis_failed",
    )


@query
def url_score(spark, sf_dir):
    findings = urls.url_findings(urls.message_urls(accepted_mail(spark, sf_dir)))
    return urls.url_score(findings)


# --- text signals ------------------------------------------------------------
def signals(spark, sf_dir, **options):
    """Cleaned text, phrase lines and signals of masked accepted mail."""
    return (
        accepted_mail(spark, sf_dir)
        .withColumn("clean", prep.clean_text(F.col("text_body")))
        .withColumn("lines", N.phrase_lines(F.col("clean")))
        .withColumn("signals", N.signals_of(F.col("clean"), F.col("lines"), **options))
    )


@query
def urgency(spark, sf_dir):
    return signals(spark, sf_dir).select("message_id", rounded(F.col("signals.urgency")).alias("urgency"))


@query
def credential_request(spark, sf_dir):
    return signals(spark, sf_dir).select("message_id", "signals.credential_request")


@query
def payment_request(spark, sf_dir):
    return signals(spark, sf_dir).select("message_id", "signals.payment_request")


@query
def lexical_errors(spark, sf_dir):
    return signals(spark, sf_dir).select("message_id", "signals.lexical_errors")


@query
def language_mixing(spark, sf_dir):
    mixed = signals(spark, sf_dir, min_hits=1).select(
        "message_id", "lang", F.col("signals.language_mixing").alias("any_mix")
    )
    return mixed


@query
def brand_mentions(spark, sf_dir):
    return signals(spark, sf_dir).select(
        "message_id",
        joined("signals.brands").alias("brands"),
        joined(N.brand_mentions(F.col("clean"), whole_word=True)).alias("whole_word_brands"),
    )


@query
def top_brands(spark, sf_dir):
    return tables.top_brands(
        signals(spark, sf_dir).select(F.col("signals.brands").alias("brands"))
    )


@query
def threat_phrases(spark, sf_dir):
    return signals(spark, sf_dir).select("message_id", joined("signals.threats").alias("threats"))


@query
def signal_descriptions(spark, sf_dir):
    return signals(spark, sf_dir).select(
        "message_id", joined(N.signal_descriptions(F.col("signals"))).alias("descriptions")
    )


@query
def text_score(spark, sf_dir):
    return signals(spark, sf_dir).select(
        "message_id", rounded(N.text_score(F.col("signals"))).alias("text_score")
    )


@query
def empty_text(spark, sf_dir):
    """Scores of all messages, the empty ones included."""
    everything = fill_defaults(mail_view(spark, sf_dir)).withColumn(
        "signals", N.text_signals(F.col("text_body"))
    )
    return (
        everything.groupBy((F.col("text_body") == "").alias("is_empty"))
        .agg(
            F.count("*").alias("n"),
            rounded(F.sum(N.text_score(F.col("signals")))).alias("total_score"),
            F.sum(F.size("signals.brands") + F.size("signals.threats")).alias("n_found"),
        )
    )


# --- attachments -------------------------------------------------------------
@query
def attachment_scores(spark, sf_dir):
    return accepted_mail(spark, sf_dir).select(
        "message_id", attachment_score(F.col("attachments")).alias("attachment_score")
    )


@query
def attachment_report(spark, sf_dir):
    return tables.attachment_report(accepted_mail(spark, sf_dir)).select(
        "message_id", "pos", "filename", "points"
    )


@query
def attachment_hash(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("message_id"),
        F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")).alias("filename"),
        F.lit("text/plain").alias("mime"),
        F.col("text").cast("binary").alias("content"),
    )
    return tables.attachment_hash(files)


# --- fusion, review, policy --------------------------------------------------
@query
def total_score(spark, sf_dir):
    return scored_mail(spark, sf_dir).select(
        "message_id", "header_score", "url_score",
        rounded(F.col("text_score")).alias("text_score"), "attachment_score",
        rounded(F.col("total_score")).alias("total_score"),
    )


@query
def heuristic_summary(spark, sf_dir):
    return scored_mail(spark, sf_dir).select(
        "message_id",
        V.heuristic_summary(
            *[F.col(f"{c}_score") for c in ("header", "url", "text", "attachment")],
            F.size("url_findings"),
            F.size("descriptions"),
        ).alias("summary"),
    )


@query
def review_request_rows(spark, sf_dir):
    return review_requests(scored_mail(spark, sf_dir)).select(
        "message_id",
        digest(F.col("headers_raw")).alias("headers_md5"),
        digest(F.col("text_body")).alias("text_md5"),
        F.size("url_metadata").alias("n_urls"),
        "heuristic_summary",
        "n_attachments",
        "n_trusted",
        joined("owned_domains").alias("owned_domains"),
        "user_locale",
        "latency_budget_ms",
    )


def stub_reviewer(prompts):
    """Deterministic stand-in for an external reviewer, used by tests and queries."""
    return [
        '{"classification": "phishing", "risk_score": 77}' if "password" in p else "no idea"
        for p in prompts
    ]


@query
def reviewer_answers(spark, sf_dir):
    requests = review_requests(heuristics(accepted_mail(spark, sf_dir)))
    return score_with_reviewer(requests, stub_reviewer)


def review_texts(rows: DataFrame, *more: str) -> DataFrame:
    """Reviewer answers in all shapes: valid, bad label, float score, no JSON, long."""
    def answer(label, score):
        return F.concat(
            F.lit('Here it is: {"classification": "' + label + '", "risk_score": '),
            score.cast("string"),
            F.lit(
                ', "top_reasons": ["a", "b", "c", "d"], "non_technical_summary": "'
                + "x" * 150 + '", "recommended_actions": ["e"], "evidence": '
                '{"header_findings": {"spf_dkim_dmarc": "fail"}, "url_findings": [], '
                '"nlp_signals": ["s"]}} thanks'
            ),
        )

    case = F.col("message_id") % 7
    score = (F.col("message_id") % 101).cast("int")
    response = (
        F.when(case == 0, answer("phishing", score))
        .when(case == 1, answer("seguro", score))
        .when(case == 2, answer("sospechoso", score))
        .when(case == 3, answer("danger", score))
        .when(case == 4, answer("seguro", score + F.lit(0.5)))
        .when(case == 5, answer("seguro", score + 101))
        .otherwise("I cannot tell")
    )
    return rows.select("message_id", *more, response.alias("response"))


@query
def parse_review(spark, sf_dir):
    reviews = review_texts(accepted_mail(spark, sf_dir)).withColumn(
        "review", V.parse_review(F.col("response"))
    )
    return reviews.filter(F.col("review").isNotNull()).select(
        "message_id",
        F.col("review.label").alias("label"),
        F.col("review.risk_score").alias("risk_score"),
        joined("review.top_reasons").alias("top_reasons"),
        F.length("review.summary").alias("summary_chars"),
        joined("review.actions").alias("actions"),
        F.col("review.evidence.header.auth").alias("auth"),
    )


def flat_verdict(verdicts: DataFrame, *more) -> DataFrame:
    return verdicts.select(
        "message_id",
        F.col("verdict.label").alias("label"),
        F.col("verdict.risk_score").alias("risk_score"),
        joined("verdict.top_reasons").alias("top_reasons"),
        F.col("verdict.summary").alias("summary"),
        joined("verdict.actions").alias("actions"),
        *more,
    )


@query
def fallback_verdict(spark, sf_dir):
    return flat_verdict(
        scored_mail(spark, sf_dir).withColumn("verdict", V.fallback_verdict(F.col("total_score")))
    )


@query
def combined_review(spark, sf_dir):
    mail = accepted_mail(spark, sf_dir)
    return flat_verdict(
        combine_review(heuristics(mail), review_texts(mail)),
        joined("evidence.signals").alias("signals"),
    )


@query
def critical_signals(spark, sf_dir):
    return scored_mail(spark, sf_dir).select(
        "message_id",
        joined(
            V.critical_signals(F.col("findings"), F.col("url_findings"), F.col("signals"))
        ).alias("critical"),
    )


def reviewed(spark, sf_dir):
    mail = accepted_mail(spark, sf_dir)
    return combine_review(heuristics(mail), review_texts(mail)).withColumn(
        "critical",
        V.critical_signals(F.col("findings"), F.col("url_findings"), F.col("signals")),
    )


@query
def elevated_verdict(spark, sf_dir):
    return flat_verdict(
        reviewed(spark, sf_dir).withColumn(
            "verdict", V.elevate(F.col("verdict"), F.col("critical"))
        )
    )


@query
def score_label_consistency(spark, sf_dir):
    return flat_verdict(
        reviewed(spark, sf_dir).withColumn(
            "verdict", V.score_label_consistency(F.col("verdict"))
        )
    )


@query
def policy_verdict(spark, sf_dir):
    return flat_verdict(apply_policy(reviewed(spark, sf_dir).drop("critical")))


@query
def error_verdicts(spark, sf_dir):
    _, rejected = require_content(fill_defaults(mail_view(spark, sf_dir)))
    return error_verdict(rejected).select(
        "message_id", "label", "risk_score", joined("top_reasons").alias("top_reasons"),
        "summary", joined("actions").alias("actions"),
        joined("evidence.signals").alias("signals"),
    )


def review_wording(spark, sf_dir):
    """Conversation turns with a closing remark, as review prose."""
    remarks = [
        "VEREDICTO: PHISHING", "VEREDICTO: SOSPECHOSO", "VEREDICTO: SPAM",
        "VEREDICTO: SEGURO", "Hay una estafa", "Es publicidad", "Mucha precaución",
        "Clasificación final: malicioso", "Clasificación final: seguro",
        "Es malicioso", "Presenta riesgos", "Parece un correo seguro", "",
    ]
    remark = F.get(strings(remarks), ((F.col("conv_id") * 3 + F.col("turn")) % len(remarks)).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat("text", F.lit(" "), remark).alias("review")
    )


@query
def four_class_verdict(spark, sf_dir):
    rows = review_wording(spark, sf_dir).withColumn("v", V.four_class_verdict(F.col("review")))
    return rows.select(
        "conv_id", "turn", "v.label", "v.risk_score", "v.explanation",
        joined("v.recommendations").alias("recommendations"),
    )


@query
def file_class_verdict(spark, sf_dir):
    rows = review_wording(spark, sf_dir).withColumn("v", V.file_class_verdict(F.col("review")))
    return rows.select("conv_id", "turn", "v.label", "v.risk_score")


def message4(spark, sf_dir):
    """Four-class messages: documents with the sender of their mail."""
    sender = H.mailbox(H.header_fields(F.col("raw_headers"))["from_field"])["address"]
    return accepted_mail(spark, sf_dir).select(
        "message_id", F.col("text_body").alias("email_body"), sender.alias("sender"),
        F.concat(F.lit("mail "), F.col("message_id")).alias("subject"), "attachments",
    )


@query
def review_four_classes(spark, sf_dir):
    remark = F.get(
        strings(["VEREDICTO: PHISHING", "veredicto: spam", "Es una estafa", "Todo bien", ""]),
        (F.col("message_id") % 5).cast("int"),
    )
    mail = message4(spark, sf_dir)
    unanswered = F.col("message_id") % 4 == 2
    reviews = mail.select("message_id", F.when(~unanswered, remark).alias("response"))
    return four_class.judge(mail, reviews).select(
        "message_id", "label", "risk_score", "analysis", "explanation",
        joined("recommendations").alias("recommendations"),
        F.concat_ws(",", F.col("details")["sender"], F.col("details")["attachments"]).alias("details"),
    )


@query
def four_class_request_rows(spark, sf_dir):
    requests = four_class.review_requests(message4(spark, sf_dir))
    return requests.select(
        "message_id", "sender", "subject", digest(F.col("body")).alias("body_md5"), "n_attachments"
    )


@query
def canonical_label(spark, sf_dir):
    words = ["Phishing", "MALICIOUS", "sospechoso", "suspicious", "Spam", "seguro", "safe"]
    raw = F.coalesce(
        F.get(strings(words), (F.col("event_id") % 9).cast("int")), F.col("event_type")
    )
    return (
        table(spark, sf_dir, "events")
        .groupBy(V.canonical_label(raw).alias("label"))
        .agg(F.count("*").alias("n"))
    )


@query
def risk_band(spark, sf_dir):
    return (
        log_view(spark, sf_dir)
        .groupBy(V.risk_band(F.col("risk_score")).alias("band"))
        .agg(F.count("*").alias("n"))
    )


@query
def evidence_text(spark, sf_dir):
    return scored_mail(spark, sf_dir).select(
        "message_id",
        V.evidence_text(F.col("findings")).alias("headers"),
        V.url_lines(F.col("url_findings")).alias("urls"),
        V.signal_lines(F.col("descriptions")).alias("signals"),
    )


def verdict_rows(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(
        "message_id", "label", "risk_score", joined("top_reasons").alias("top_reasons"),
        joined("heuristics.critical").alias("critical"),
        rounded(F.col("heuristics.total_score")).alias("total_score"),
    )


@query
def classify_mail(spark, sf_dir):
    return verdict_rows(classify(mail_view(spark, sf_dir)))


@query
def classify_mail_intel(spark, sf_dir):
    mail = mail_view(spark, sf_dir)
    intel = intel_of(urls.message_urls(mail))
    return verdict_rows(classify(mail, intel=intel, as_of=AS_OF))


@query
def label_distribution(spark, sf_dir):
    return (
        classify(mail_view(spark, sf_dir))
        .groupBy("label")
        .agg(F.count("*").alias("n"), F.sum("risk_score").alias("sum_score"))
    )


# --- monitoring --------------------------------------------------------------
def log_query(name, operator, *columns, **options):
    """A windowed log metric with its times as text and doubles rounded."""

    def run(spark, sf_dir):
        result = operator(log_view(spark, sf_dir), **options)
        shown = [
            time_text(c) if c == "window_start"
            else rounded(F.col(c)).alias(c) if kind == "double" else F.col(c)
            for c, kind in result.dtypes
            if c != "window_end"
        ]
        return result.select(*shown)

    QUERIES[name] = run


log_query("request_counts", monitor.request_counts)
log_query("duration_histogram", monitor.duration_histogram)
log_query("duration_heatmap", monitor.duration_heatmap, width="6 hours")
log_query("latency_quantiles", monitor.latency_quantiles, width="1 hour", exact=True)
log_query("request_rate", monitor.request_rate, width="1 hour")
log_query("request_rate_minute", monitor.request_rate)
log_query("availability", monitor.availability, width="6 hours", slide="1 hour")
log_query("availability_10m", monitor.availability)
log_query("error_rate", monitor.error_rate, width="6 hours", slide="1 hour")
log_query("label_counts", monitor.label_counts)
log_query("phishing_share", monitor.phishing_share, width="6 hours", slide="1 hour")
log_query("low_volume", monitor.low_volume, width="10 minutes", per_minute=0.2)
log_query("error_types", monitor.error_types, width="6 hours")
log_query("security_events", monitor.security_events)
log_query("auth_failures", monitor.auth_failures, width="6 hours", slide="1 hour", per_second=0.0002)
log_query("dependency_health", monitor.dependency_health, width="6 hours", exact=True)
log_query("monthly_slo", monitor.monthly_slo)
log_query("risk_level_metric", monitor.risk_level_metric)
log_query("top_sources", monitor.top_sources)


@query
def within_slo(spark, sf_dir):
    return monitor.within_slo(log_view(spark, sf_dir)).groupBy("endpoint", "within_slo").agg(
        F.count("*").alias("n")
    )


@query
def gauge_alerts(spark, sf_dir):
    result = monitor.gauge_alerts(gauge_view(spark, sf_dir), "1 hour")
    flags = [
        F.coalesce(c, F.lit(False)).alias(c)
        for c, kind in result.dtypes
        if kind == "boolean"
    ]
    return result.select(time_text(), "instance", *flags)


ALERT_STEP = "1 hour"
ALERT_HOLDS = {"quiet_hour": 7200, "error_burst": 3600, "phishing_wave": 10800}


def evaluated_rules(spark, sf_dir):
    """Three rules at every hour of the log."""
    logs = log_view(spark, sf_dir)
    counts = monitor.tumbling(
        logs,
        ALERT_STEP,
        n=F.count_if(F.col("classification").isNotNull()),
        n_all=F.count("*"),
        n_5xx=F.count_if(monitor.is_5xx()),
        n_phishing=F.count_if(F.col("classification") == "phishing"),
    ).drop("window_end")
    conditions = {
        "quiet_hour": F.col("n") < 8,
        "error_burst": monitor.percent(F.col("n_5xx"), F.col("n_all")) > 5,
        "phishing_wave": monitor.percent(F.col("n_phishing"), F.col("n")) > 15,
    }
    counts = settled(counts, "counts")
    return alerts.rule_ticks(counts, monitor.calendar(counts, ALERT_STEP), conditions)


@query
def sustained_alert(spark, sf_dir):
    fired = alerts.sustained_alert(evaluated_rules(spark, sf_dir), ALERT_HOLDS, ALERT_STEP)
    return fired.select(
        "rule", time_text("since"), time_text("fired_at"), time_text("last_true"), "n_firing"
    )


@query
def service_alerts(spark, sf_dir):
    fired = service_rules.service_alerts(log_view(spark, sf_dir), gauge_view(spark, sf_dir))
    return fired.select(
        "rule", "series", "severity", time_text("since"), time_text("fired_at"), time_text("last_true"), "n_firing"
    )


NEWEST = 50


@query
def log_search(spark, sf_dir):
    found = monitor.keyword_search(log_view(spark, sf_dir), NEWEST, "event_id")
    return found.select("event_id", time_text("ts"), "level", "event")


@query
def slow_requests(spark, sf_dir):
    found = monitor.slow_requests(log_view(spark, sf_dir), NEWEST, "event_id")
    return found.select("event_id", time_text("ts"), "duration_ms", "endpoint")


@query
def failed_requests(spark, sf_dir):
    found = monitor.failed_requests(log_view(spark, sf_dir), NEWEST, "event_id")
    return found.select("event_id", time_text("ts"), "status", "remote_ip")


# --- evaluation --------------------------------------------------------------
def results(spark, sf_dir):
    """Labels as cases: a document whose mail was rejected has no verdict and fails.

    The log row of the same number says how long the request took.
    """
    toxic = F.col("toxic") == 1
    expected = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("name"),
        F.concat(F.lit("quality "), "quality").alias("category"),
        F.when(toxic, "phishing").otherwise("seguro").alias("expected_label"),
        F.when(toxic, 70).otherwise(20).alias("expected_score"),
    )
    measured = log_view(spark, sf_dir).select(F.col("event_id").alias("name"), F.col("duration_ms").alias("latency_ms"))
    actual = classify(mail_view(spark, sf_dir)).select(
        F.col("message_id").alias("name"), "label", "risk_score"
    ).join(measured, "name", "left")
    return evaluate.case_result(expected, actual)


def judged(spark, sf_dir):
    mail = labelled(spark, sf_dir)
    verdicts = classify(mail, keep=("expected_label",))
    return verdicts.withColumn("total_score", F.col("heuristics.total_score"))


@query
def case_result(spark, sf_dir):
    return results(spark, sf_dir).withColumns(
        {"label": F.coalesce("label", F.lit("")), "score_diff": F.coalesce("score_diff", F.lit(-1))}
    )


@query
def category_pass_rate(spark, sf_dir):
    return evaluate.category_pass_rate(results(spark, sf_dir)).withColumn(
        "pass_pct", rounded(F.col("pass_pct"))
    )


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(judged(spark, sf_dir))


@query
def quality_rates(spark, sf_dir):
    return evaluate.quality_rates(judged(spark, sf_dir)).withColumns(
        {c: rounded(F.col(c)) for c in ("fp_pct", "fn_pct")}
    )


@query
def threshold_table(spark, sf_dir):
    return evaluate.threshold_table(scored_mail(spark, sf_dir))


@query
def threshold_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(judged(spark, sf_dir))


# --- streaming ---------------------------------------------------------------
def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables, a file or a folder of files, as a file stream.

    Streams read folders only, but a pattern may stand for either.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def drained(stream: DataFrame, purpose: str) -> DataFrame:
    """Run a stream over all input there is and read what it wrote.

    Every partition of every stateful step keeps a store of its own, so there are no more than tasks at a time.
    """
    spark = stream.sparkSession
    path = shared_dir(spark, purpose)
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), max(4, spark.sparkContext.defaultParallelism)))
    try:
        run = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{path}/rows")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query
def classify_stream_rows(spark, sf_dir):
    mail = mail_of(stream_of(spark, sf_dir, "documents")).withColumn(
        "received_at", F.timestamp_seconds(F.col("message_id") + 1704067200)
    )
    return verdict_rows(drained(classify_stream(mail), "verdict-stream"))


def streamed_metrics(spark, sf_dir):
    logs = log_of(stream_of(spark, sf_dir, "events")).withColumn(
        "ts", F.col("ts").cast("timestamp")
    )
    return drained(metrics_stream(logs, ALERT_STEP), "metric-stream")


@query
def metrics_stream_rows(spark, sf_dir):
    return streamed_metrics(spark, sf_dir).select(
        time_text(), "n_requests", "n_5xx", "n_4xx", "n_auth", "n_classified", "n_phishing"
    )


@query
def alerts_stream_rows(spark, sf_dir):
    """Two rules on every hour of the log, hours without rows included, and their changes of state."""
    logs = log_of(stream_of(stateful(spark), sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    sums = {
        "n_requests": F.count("*"),
        "n_5xx": F.count_if(monitor.is_5xx()),
        "n_classified": F.count_if(monitor.classified()),
    }
    conditions = {
        "error_burst": lambda of: monitor.percent(of("n_5xx"), of("n_requests")) > 5,
        "quiet_hour": lambda of: of("n_classified") < 8,
    }
    step = step_seconds(ALERT_STEP)
    buckets = streams.step_buckets(logs, ALERT_STEP, F.lit("all"), "10 minutes", sums)
    windows = sliding_stream(buckets, list(sums), [step], step, "series")
    ticks = streams.alerts_of_windows(windows, conditions, lambda rule: step)
    changes = drained(alerts_stream(ticks, ALERT_HOLDS, step), "alert-stream")
    return changes.select("rule", time_text("ts"), "state", time_text("since"))
