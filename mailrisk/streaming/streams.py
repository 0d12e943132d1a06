"""Continuous scoring, metrics and alerts."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.functions import verdict as V
from mailrisk.functions.verdict import canonical_label
from mailrisk.operators import service_rules
from mailrisk.operators.alerts import step_seconds
from mailrisk.operators.fuse import apply_policy, gravest, heuristics, judged_by
from mailrisk.operators.monitor import classified, is_5xx, tumbling
from mailrisk.operators.validate import fill_defaults, require_content
from mailrisk.plans.classify import FEATURES, SCORES, classify, verdict_columns
from mailrisk.streaming.stateful import alerts_stream, closing, sliding_stream


def classify_stream(messages: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """One verdict per message of a stream with an event time ``received_at``.

    Redelivered messages are dropped while their first copy is inside the
    watermark; scoring itself keeps no state.
    """
    once = messages.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(
        ["message_id"]
    )
    return classify(once, keep=("received_at",))


def reviewed_stream(
    messages: DataFrame, reviews: DataFrame, wait: str = "10 minutes", lateness: str = "1 hour"
) -> DataFrame:
    """One verdict per message of a stream, by the reviews of it that come in time.

    ``reviews`` has ``message_id, response`` and the event time ``reviewed_at``.  A message waits ``wait`` for
    reviews: the gravest valid one decides; without any the score does, as soon as the watermark says that none
    can come.  Only features wait in the state, not bodies.
    """
    once = messages.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["message_id"])
    accepted, _ = require_content(fill_defaults(once))
    scored = heuristics(accepted).select("message_id", "received_at", F.struct(*FEATURES).alias("features"))
    answers = reviews.withWatermark("reviewed_at", lateness).select(
        F.col("message_id").alias("reviewed_id"), "reviewed_at", V.parse_review(F.col("response")).alias("review")
    ).where(F.col("review").isNotNull())
    in_time = F.col("reviewed_at").between(F.col("received_at"), F.col("received_at") + F.expr(f"interval {wait}"))
    joined = scored.join(answers, (F.col("message_id") == F.col("reviewed_id")) & in_time, "left_outer")
    gathered = joined.groupBy(F.window("received_at", "1 minute"), "message_id").agg(
        F.first("received_at").alias("received_at"), F.first("features").alias("features"), gravest("review")
    )
    return verdict_columns(
        apply_policy(judged_by(gathered.select("message_id", "received_at", "features.*", "review"))), ("received_at",)
    )


def corrections_stream(
    verdicts: DataFrame, reviews: DataFrame, wait: str = "10 minutes", horizon: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """Corrections of verdicts by answers that came after ``wait`` but within ``horizon``.

    ``verdicts`` is the table that ``reviewed_stream`` writes, read as a stream.  Every message with a late
    valid answer gets one row, by the gravest of all its reviews up to ``horizon``; messages without keep their verdict.
    """
    told = verdicts.withWatermark("received_at", lateness).select(
        "message_id", "received_at", F.struct("heuristics", F.struct("label", "risk_score").alias("first")).alias("told")
    )
    answers = reviews.withWatermark("reviewed_at", lateness).select(
        F.col("message_id").alias("reviewed_id"), "reviewed_at", V.parse_review(F.col("response")).alias("review")
    ).where(F.col("review").isNotNull())
    received = F.col("received_at")
    known = F.col("reviewed_at").between(received, received + F.expr(f"interval {horizon}"))
    late = F.col("reviewed_at") > received + F.expr(f"interval {wait}")
    gathered = (
        told.join(answers, (F.col("message_id") == F.col("reviewed_id")) & known)
        .groupBy(F.window("received_at", "1 minute"), "message_id")
        .agg(F.first("told").alias("told"), F.max("reviewed_at").alias("corrected_at"), F.count_if(late).alias("n_late"), gravest("review"))
        .where("n_late > 0")
    )
    critical = F.col("told.heuristics.critical")
    verdict = V.score_label_consistency(V.elevate(F.col("review"), critical))
    return gathered.withColumn("verdict", verdict).select(
        "message_id", "corrected_at", F.col("told.first.label").alias("first_label"), "verdict.label", "verdict.risk_score",
        "verdict.top_reasons", "verdict.summary", "verdict.actions", "n_late",
    )


def metrics_stream(logs: DataFrame, width: str = "5 minutes", lateness: str = "10 minutes"):
    """Service counts per window; rows later than the watermark are dropped."""
    label = canonical_label(F.col("classification"))
    return (
        logs.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"))
        .agg(
            F.count("*").alias("n_requests"),
            F.count_if(is_5xx()).alias("n_5xx"),
            F.count_if(F.col("status").between(400, 499)).alias("n_4xx"),
            F.count_if(F.col("error_type") == "authentication_failed").alias("n_auth"),
            F.count_if(classified()).alias("n_classified"),
            F.count_if(classified() & (label == "phishing")).alias("n_phishing"),
            F.percentile_approx("duration_ms", 0.95).alias("p95_ms"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "n_requests", "n_5xx", "n_4xx", "n_auth", "n_classified", "n_phishing", "p95_ms",
        )
    )


def alerts_of_windows(windows: DataFrame, conditions: dict, width_of) -> DataFrame:
    """``rule, series, ts, breach, closes`` of rules whose window a row is, see ``sliding_stream``."""
    checks = [
        F.when(
            F.col("width") == width_of(rule),
            F.struct(F.lit(rule).alias("rule"), F.coalesce(condition(F.col), F.lit(False)).alias("breach")),
        )
        for rule, condition in conditions.items()
    ]
    return windows.select(
        "series", F.col("window_start").alias("ts"), "closes", F.explode(F.array_compact(F.array(*checks))).alias("c")
    ).select("c.rule", "series", "ts", "c.breach", "closes")


def step_buckets(rows: DataFrame, step: str, series, lateness: str, sums: dict) -> DataFrame:
    """Rows of a stream aggregated to one bucket per step and series, as ``sliding_stream`` takes them."""
    watched = rows.withWatermark("ts", lateness).withColumn("series", series)
    buckets = watched.groupBy(F.window("ts", step).alias("w"), "series").agg(*[c.alias(n) for n, c in sums.items()])
    return closing(buckets)


def service_alerts_stream(
    logs: DataFrame, gauges: DataFrame | None = None, step: str = "1 minute", lateness: str = "10 minutes"
) -> DataFrame:
    """State changes of all alert rules: ``rule, series, severity, ts, state, since``.

    Log and gauge rows become buckets of one step, buckets windows of every width that a rule has, empty ones
    included, windows conditions, and conditions that hold alerts.  A tick is judged when the watermark
    passes its end, so rows that are late by less than ``lateness`` count, in whatever order they come.
    """
    parts = []
    every = step_seconds(step)
    for rows, sums, conditions, series in (
        (logs, service_rules.log_sums(), service_rules.log_conditions(), F.lit("all")),
        (gauges, service_rules.gauge_sums(), service_rules.gauge_conditions(), F.col("instance")),
    ):
        if rows is None:
            continue
        widths = sorted({service_rules.seconds_of(rule) for rule in conditions})
        windows = sliding_stream(step_buckets(rows, step, series, lateness, sums), list(sums), widths, every, "series")
        parts.append(alerts_of_windows(windows, conditions, service_rules.seconds_of))
    changes = alerts_stream(reduce(DataFrame.unionByName, parts), service_rules.rule_holds(), every)
    return changes.withColumn("severity", service_rules.severity(F.col("rule")))


def low_volume_stream(
    logs: DataFrame, width: str = "10 minutes", per_minute: float = 5, lateness: str = "10 minutes"
) -> DataFrame:
    """``monitor.low_volume`` of a stream: windows with too few classifications, empty ones too."""
    seconds = step_seconds(width)
    buckets = step_buckets(logs, width, F.lit("all"), lateness, {"n": F.count_if(classified())})
    rate = F.col("n") / (seconds / 60)
    return sliding_stream(buckets, ["n"], [seconds], seconds, "series").select(
        "window_start", rate.alias("per_minute"), (rate < per_minute).alias("breach")
    )


def request_counts_stream(logs: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """``monitor.request_counts`` per window, to be summed by whoever reads them."""
    keys = ("method", "endpoint", "status")
    return tumbling(logs.withWatermark("ts", lateness), width, *keys, n_requests=F.count("*"))
