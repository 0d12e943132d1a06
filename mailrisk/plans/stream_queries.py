"""Streams over the whole tables, drained; each gives what its batch query gives for closed windows."""

from pyspark.sql import functions as F

from mailrisk.operators import monitor
from mailrisk.plans.queries import drained, joined, review_texts, rounded, stream_of, time_text
from mailrisk.plans.views import gauge_of, log_of, mail_of
from mailrisk.session import stateful
from mailrisk.streaming import streams

QUERIES = {}
LATENESS = "10 minutes"


def query(function):
    QUERIES[function.__name__] = function
    return function


def event_stream(spark, sf_dir, view):
    return view(stream_of(stateful(spark), sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


def shown(rows):
    """Times as text and doubles rounded."""
    return rows.select(
        *[
            time_text(c) if c == "window_start" else rounded(F.col(c)).alias(c) if kind == "double" else F.col(c)
            for c, kind in rows.dtypes
            if c != "window_end"
        ]
    )


def stream_query(name, operator, **options):
    """The batch operator on a watermarked stream of the log."""

    def run(spark, sf_dir):
        logs = event_stream(spark, sf_dir, log_of).withWatermark("ts", LATENESS)
        return shown(drained(operator(logs, **options), name))

    QUERIES[f"{name}_stream"] = run


# windows of each, as in the batch queries of the same names
WIDTHS = {
    "duration_heatmap": "6 hours", "request_rate": "1 hour", "availability": "6 hours", "error_rate": "6 hours", "label_counts": "1 hour",
    "phishing_share": "6 hours", "low_volume": "10 minutes", "error_types": "6 hours", "auth_failures": "6 hours",
}
stream_query("duration_heatmap", monitor.duration_heatmap, width="6 hours")
stream_query("request_rate", monitor.request_rate, width="1 hour")
stream_query("availability", monitor.availability, width="6 hours", slide="1 hour")
stream_query("error_rate", monitor.error_rate, width="6 hours", slide="1 hour")
stream_query("label_counts", monitor.label_counts)
stream_query("phishing_share", monitor.phishing_share, width="6 hours", slide="1 hour")
stream_query("error_types", monitor.error_types, width="6 hours")
stream_query("auth_failures", monitor.auth_failures, width="6 hours", slide="1 hour", per_second=0.0002)


@query
def low_volume_stream(spark, sf_dir):
    logs = event_stream(spark, sf_dir, log_of)
    return shown(drained(streams.low_volume_stream(logs, per_minute=0.2, lateness=LATENESS), "low-volume"))


@query
def request_counts_stream(spark, sf_dir):
    closed = drained(streams.request_counts_stream(event_stream(spark, sf_dir, log_of), lateness=LATENESS), "request-counts")
    return closed.groupBy("method", "endpoint", "status").agg(F.sum("n_requests").alias("n_requests"))


@query
def latency_quantiles_stream(spark, sf_dir):
    """Sketches of a stream, merged to sliding windows: counts equal the batch's, quantiles lie between the extremes."""
    logs = event_stream(spark, sf_dir, log_of).withWatermark("ts", LATENESS)
    rows = drained(monitor.latency_quantiles(logs, "6 hours", "1 hour"), "latency")
    return rows.select(time_text(), "n_requests", ((F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("p99"))).alias("in_order"))


@query
def service_alerts_stream(spark, sf_dir):
    """Changes of all sixteen rules; logs and gauges are two streams."""
    logs, gauges = event_stream(spark, sf_dir, log_of), event_stream(spark, sf_dir, gauge_of)
    changes = drained(streams.service_alerts_stream(logs, gauges, lateness=LATENESS), "service-alerts")
    return changes.select("rule", "series", "severity", time_text("ts"), "state", F.coalesce(time_text("since"), F.lit("")).alias("since"))


# --- reviews that arrive later --------------------------------------------------------
WAIT = "5 minutes"


def timed_mail(spark, sf_dir):
    """A mail every ten minutes."""
    at = F.timestamp_seconds(F.col("message_id") * 600 + 1704067200)
    return mail_of(stream_of(stateful(spark), sf_dir, "documents")).withColumn("received_at", at)


def timed_reviews(spark, sf_dir):
    """Answers 0, 200, 400 or 600 seconds after a mail; half of them come too late."""
    mail = timed_mail(spark, sf_dir)
    at = F.col("received_at") + F.make_dt_interval(secs=F.col("message_id") % 4 * 200)
    texts = review_texts(mail.withColumn("reviewed_at", at), "reviewed_at")
    return texts


def closed_only(rows, spark, sf_dir):
    """Rows of the time that any watermark has passed, a day before the last mail."""
    last = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.max("doc_id")).scalar()
    return rows.where(F.col("message_id") < last - 144)


@query
def reviewed_stream_rows(spark, sf_dir):
    verdicts = streams.reviewed_stream(timed_mail(spark, sf_dir), timed_reviews(spark, sf_dir), WAIT, LATENESS)
    rows = closed_only(drained(verdicts, "reviewed"), spark, sf_dir)
    return rows.select("message_id", "label", "risk_score", joined("top_reasons").alias("top_reasons"))


@query
def corrections_stream_rows(spark, sf_dir):
    """What late answers change of the verdicts told before."""
    told = streams.reviewed_stream(timed_mail(spark, sf_dir), timed_reviews(spark, sf_dir), WAIT, LATENESS)
    written = drained(told, "told")
    path = written.inputFiles()[0].rsplit("/", 1)[0] if written.inputFiles() else None
    if path is None:
        return spark.createDataFrame([], "message_id bigint, first_label string, label string, risk_score int, n_late bigint")
    verdicts = spark.readStream.schema(written.schema).parquet(path)
    late = streams.corrections_stream(verdicts, timed_reviews(spark, sf_dir), WAIT, "1 hour", LATENESS)
    rows = closed_only(drained(late, "corrections"), spark, sf_dir)
    return rows.select("message_id", "first_label", "label", "risk_score", "n_late")
