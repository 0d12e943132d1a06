"""Windowed service metrics over log and gauge tables.

Rates are counts of rows in a window; nothing here needs counters.  Sliding
windows first aggregate to buckets of one slide and then combine buckets, so rows
are shuffled once, already aggregated, however far windows overlap.  The windowed
functions work on streams with a watermark as they do on tables.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions.verdict import canonical_label


def is_5xx():
    return F.col("status").between(500, 599)


def classified():
    return F.col("classification").isNotNull()


def tumbling(rows: DataFrame, width: str, *keys, **sums) -> DataFrame:
    """Aggregate into windows of ``width``; ``window_start`` leads the result."""
    return tumbling_of(rows, F.window("ts", width), *keys, **sums)


def tumbling_of(rows: DataFrame, window, *keys, **sums) -> DataFrame:
    return (
        rows.groupBy(window.alias("w"), *keys)
        .agg(*[column.alias(name) for name, column in sums.items()])
        .withColumn("window_start", F.col("w.start"))
        .withColumn("window_end", F.col("w.end"))
        .drop("w")
    )


def sliding(rows: DataFrame, width: str, slide: str | None, *keys, **counts) -> DataFrame:
    """Sums of additive columns per window of ``width`` every ``slide``."""
    if slide is None or slide == width:
        return tumbling(rows, width, *keys, **counts)
    buckets = (
        rows.groupBy(F.window("ts", slide).alias("w"), *keys)
        .agg(*[column.alias(name) for name, column in counts.items()])
        .withColumn("ts", F.window_time("w"))
        .drop("w")
    )
    return tumbling_of(buckets, F.window("ts", width, slide), *keys, **{name: F.sum(name) for name in counts})


def seconds(width: str):
    """Length of an interval text as a literal."""
    return F.expr(f"unix_seconds(timestamp_seconds(0) + interval {width})")


def percent(part, whole):
    return F.when(whole > 0, part / whole * 100)


# --- traffic -----------------------------------------------------------------
def request_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("method", "endpoint", "status").agg(
        F.count("*").alias("n_requests")
    )


def _cumulative_buckets():
    """Histogram as ``array<struct<le, n>>`` from one aggregation."""
    bounds = [*rules.DURATION_BUCKETS, float("inf")]
    return F.array(
        *[
            F.struct(
                F.lit("+Inf" if b == float("inf") else str(b)).alias("le"),
                F.count_if(F.col("duration_ms") <= b * 1000).alias("n"),
            )
            for b in bounds
        ]
    )


def duration_histogram(logs: DataFrame, *keys) -> DataFrame:
    """Cumulative request-duration buckets, in seconds."""
    return (
        logs.groupBy(*keys)
        .agg(_cumulative_buckets().alias("buckets"))
        .select(*keys, F.explode("buckets").alias("b"))
        .select(*keys, "b.le", "b.n")
    )


def duration_heatmap(logs: DataFrame, width: str = "1 minute") -> DataFrame:
    """The histogram per window."""
    return (
        tumbling(logs, width, buckets=_cumulative_buckets())
        .select("window_start", F.explode("buckets").alias("b"))
        .select("window_start", "b.le", "b.n")
    )


SKETCH_K = 800  # ranks are right within 0.5 % of a window's rows, with high probability


def _points():
    return F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))


def latency_quantiles(
    logs: DataFrame, width: str = "5 minutes", slide: str | None = None, exact: bool = False
) -> DataFrame:
    """P50, P95 and P99 of durations per window.

    Each bucket of one slide has a mergeable sketch of a few kilobytes, however many durations it
    stands for, and windows merge the sketches of their buckets.  ``exact`` takes the percentile of
    all values of a (tumbling) window instead, which keeps every distinct value in one state.
    """
    names = ("p50", "p95", "p99")
    if exact:
        windows = tumbling(logs, width, q=F.percentile("duration_ms", _points()), n_requests=F.count("*"))
    else:
        windows = duration_sketches(logs, width, slide).withColumn("q", quantiles_of("sketch", _points()))
    return windows.select(
        "window_start", "n_requests", *[F.col("q")[i].cast("double").alias(n) for i, n in enumerate(names)]
    )


def duration_sketches(logs: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """``window_start, window_end, n_requests, sketch`` of every window."""
    sketch = F.kll_sketch_agg_bigint("duration_ms", SKETCH_K)
    if slide is None or slide == width:
        return tumbling(logs, width, n_requests=F.count("*"), sketch=sketch)
    buckets = logs.groupBy(F.window("ts", slide).alias("w")).agg(F.count("*").alias("n"), sketch.alias("part"))
    return tumbling_of(
        buckets.withColumn("ts", F.window_time("w")).drop("w"), F.window("ts", width, slide),
        n_requests=F.sum("n"), sketch=F.kll_merge_agg_bigint("part", SKETCH_K),
    )


def quantiles_of(sketch: str, points):
    """Values at the given ranks; null for a sketch of nothing."""
    known = F.coalesce(F.kll_sketch_get_n_bigint(sketch), F.lit(0)) > 0
    return F.when(known, F.kll_sketch_get_quantile_bigint(sketch, points))


def request_rate(logs: DataFrame, width: str = "1 minute", slide: str | None = None):
    """Requests per minute: all, classify only, server errors."""
    counts = sliding(
        logs,
        width,
        slide,
        n_all=F.count("*"),
        n_classify=F.count_if(F.col("endpoint") == "/classify"),
        n_5xx=F.count_if(is_5xx()),
    )
    minutes = seconds(width) / 60
    return counts.select(
        "window_start",
        (F.col("n_all") / minutes).alias("all_per_min"),
        (F.col("n_classify") / minutes).alias("classify_per_min"),
        (F.col("n_5xx") / minutes).alias("errors_per_min"),
    )


def availability(logs: DataFrame, width: str = "10 minutes", slide: str | None = "1 minute"):
    """Share of requests without server error, and whether it breaks the target."""
    counts = sliding(
        logs, width, slide, n_all=F.count("*"), n_good=F.count_if(~is_5xx())
    )
    share = percent(F.col("n_good"), F.col("n_all"))
    return counts.select(
        "window_start",
        "n_all",
        share.alias("availability_pct"),
        (share < rules.SLO_AVAILABILITY_PCT).alias("breach"),
    )


def error_rate(logs: DataFrame, width: str = "5 minutes", slide: str | None = None):
    """Server-error share with severity, and rates per second of error kinds."""
    counts = sliding(
        logs,
        width,
        slide,
        n_all=F.count("*"),
        n_5xx=F.count_if(is_5xx()),
        n_4xx=F.count_if(F.col("status").between(400, 499)),
        n_internal=F.count_if(F.col("error_type") == "internal_error"),
    )
    share = percent(F.col("n_5xx"), F.col("n_all"))
    return counts.select(
        "window_start",
        "n_all",
        "n_5xx",
        "n_4xx",
        "n_internal",
        share.alias("error_pct"),
        F.when(share > 15, "critical").when(share > 5, "warning").otherwise("ok").alias(
            "severity"
        ),
        (F.col("n_internal") / seconds(width) > 0.1).alias("internal_breach"),
    )


# --- verdicts ----------------------------------------------------------------
def label_counts(logs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Classifications per canonical label and window, one column per label."""
    label = canonical_label(F.col("classification"))
    return tumbling(
        logs.filter(classified()),
        width,
        **{
            name: F.count_if(label == name)
            for name in ("safe", "spam", "suspicious", "phishing")
        },
    ).drop("window_end")


def phishing_share(logs: DataFrame, width: str = "10 minutes", slide: str | None = "1 minute"):
    counts = sliding(
        logs.filter(classified()),
        width,
        slide,
        n_classified=F.count("*"),
        n_phishing=F.count_if(canonical_label(F.col("classification")) == "phishing"),
    )
    share = percent(F.col("n_phishing"), F.col("n_classified"))
    return counts.select(
        "window_start",
        "n_classified",
        "n_phishing",
        share.alias("phishing_pct"),
        (share > 25).alias("breach"),
    )


def calendar(windows: DataFrame, step: str, *keys) -> DataFrame:
    """Every ``step`` from the first to the last ``window_start``, of each key, empty ones included.

    Days are spread over the cluster before they are divided; ``step`` must divide a day.
    """
    span = windows.groupBy(*keys).agg(F.min("window_start").alias("lo"), F.max("window_start").alias("hi"))
    one_day, one_step = F.expr("interval 1 day"), F.expr(f"interval {step}")
    days = F.sequence(F.date_trunc("day", "lo"), F.date_trunc("day", "hi"), one_day)
    steps = F.sequence(F.col("day"), F.col("day") + one_day - one_step, one_step)
    return (
        span.select(*keys, "lo", "hi", F.explode(days).alias("day"))
        .repartition("day")
        .select(*keys, "lo", "hi", F.explode(steps).alias("window_start"))
        .filter(F.col("window_start").between(F.col("lo"), F.col("hi")))
        .select(*keys, "window_start")
    )


def row_calendar(rows: DataFrame, step: str, *keys) -> DataFrame:
    """``calendar`` from the rows themselves; reads their times and keys only."""
    return calendar(rows.select(*keys, F.window("ts", step)["start"].alias("window_start")), step, *keys)


def low_volume(logs: DataFrame, width: str = "10 minutes", per_minute: float = 5) -> DataFrame:
    """Windows with fewer classifications per minute than expected, empty ones too."""
    counts = tumbling(logs.filter(classified()), width, n=F.count("*")).select("window_start", "n")
    rate = F.coalesce("n", F.lit(0)) / (seconds(width) / 60)
    return (
        row_calendar(logs, width)
        .join(counts, "window_start", "left")
        .select("window_start", rate.alias("per_minute"), (rate < per_minute).alias("breach"))
    )


def within_slo(logs: DataFrame, target_ms: int = rules.SLO_LATENCY_MS) -> DataFrame:
    return logs.withColumn("within_slo", F.col("duration_ms") <= target_ms)


def risk_level_metric(logs: DataFrame, high: int = 80, medium: int = 50) -> DataFrame:
    """Rows per risk level by score cut points."""
    level = (
        F.when(F.col("risk_score") >= high, "high")
        .when(F.col("risk_score") >= medium, "medium")
        .otherwise("low")
    )
    return (
        logs.filter(F.col("risk_score").isNotNull())
        .groupBy(level.alias("risk_level"))
        .agg(F.count("*").alias("n"))
    )


# --- errors ------------------------------------------------------------------
def error_types(logs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Errors per type and window."""
    errors = logs.filter(F.col("error_type").isNotNull())
    return tumbling(errors, width, "error_type", n_errors=F.count("*")).drop("window_end")


SECURITY_TYPES = ["authentication_failed", "invalid_request", "rate_limit_exceeded"]


def security_events(logs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Security-relevant errors per window."""
    errors = logs.filter(F.col("error_type").isin(SECURITY_TYPES))
    return tumbling(errors, width, n_events=F.count("*")).drop("window_end")


def auth_failures(
    logs: DataFrame, width: str = "5 minutes", slide: str | None = None,
    per_second: float = 1.0,
) -> DataFrame:
    """Rate of failed authentications per second and whether it is too high."""
    failures = logs.filter(F.col("error_type") == "authentication_failed")
    counts = sliding(failures, width, slide, n_failures=F.count("*"))
    rate = F.col("n_failures") / seconds(width)
    return counts.select(
        "window_start",
        "n_failures",
        rate.alias("per_second"),
        (rate > per_second).alias("breach"),
    )


def dependency_health(
    logs: DataFrame, component: str = "reviewer", width: str = "5 minutes", exact: bool = False
) -> DataFrame:
    """Request rate, error rate and P95 latency of one component, with breaches.

    The latency comes from a sketch; ``exact`` keeps every distinct value instead.
    """
    failed = is_5xx() | (F.col("level") == "ERROR")
    p95 = F.percentile("duration_ms", 0.95) if exact else F.kll_sketch_agg_bigint("duration_ms", SKETCH_K)
    health = tumbling(
        logs.filter(F.col("component") == component),
        width,
        n_calls=F.count("*"),
        n_errors=F.count_if(failed),
        p95_ms=p95,
    )
    if not exact:
        health = health.withColumn("p95_ms", quantiles_of("p95_ms", F.lit(0.95)).cast("double"))
    error_rate = F.col("n_errors") / seconds(width)
    return health.select(
        "window_start",
        (F.col("n_calls") / (seconds(width) / 60)).alias("calls_per_min"),
        error_rate.alias("errors_per_sec"),
        "p95_ms",
        (error_rate > 0.05).alias("error_breach"),
        (F.col("p95_ms") > 10000).alias("latency_breach"),
    )


# --- gauges ------------------------------------------------------------------
def gauge_alerts(gauges: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Gauge rules per instance and window; rules without samples stay null."""

    def mean(metric):
        return F.avg(F.when(F.col("metric") == metric, F.col("value")))

    def total(metric):
        return F.sum(F.when(F.col("metric") == metric, F.col("value")))

    windows = tumbling(
        gauges,
        width,
        "instance",
        up_min=F.min(F.when(F.col("metric") == "up", F.col("value"))),
        cpu=mean("cpu_pct"),
        used=mean("memory_used"),
        limit=mean("memory_limit"),
        restarts=total("restarts"),
        failed=total("deployment_failed"),
        reachable=mean("uptime_check"),
    )
    memory = percent(F.col("used"), F.col("limit"))
    return windows.select(
        "window_start",
        "instance",
        (F.col("up_min") == 0).alias("service_down"),
        (F.col("cpu") > 80).alias("high_cpu"),
        (memory > 85).alias("high_memory"),
        (F.col("restarts") > 3).alias("frequent_restarts"),
        (F.col("failed") > 0).alias("failed_deployment"),
        (F.col("reachable") < 0.8).alias("unreachable"),
    )


# --- objectives --------------------------------------------------------------
def monthly_slo(
    logs: DataFrame,
    target_ms: int = rules.SLO_LATENCY_MS,
    availability_pct: float = rules.SLO_AVAILABILITY_PCT,
    latency_pct: float = rules.SLO_LATENCY_SHARE_PCT,
) -> DataFrame:
    """Availability and latency objectives per calendar month with error budget."""
    counts = logs.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_requests"),
        F.count_if(~is_5xx()).alias("n_good"),
        F.count_if(F.col("duration_ms") < target_ms).alias("n_fast"),
    )
    available = percent(F.col("n_good"), F.col("n_requests"))
    fast = percent(F.col("n_fast"), F.col("n_requests"))
    allowed = F.col("n_requests") * (1 - availability_pct / 100)
    spent = F.col("n_requests") - F.col("n_good")
    return counts.select(
        "month",
        "n_requests",
        available.alias("availability_pct"),
        fast.alias("fast_pct"),
        (available >= availability_pct).alias("availability_met"),
        (fast >= latency_pct).alias("latency_met"),
        (1 - spent / F.nullif(allowed, F.lit(0.0))).alias("budget_left"),
    )


# --- searches ----------------------------------------------------------------
def log_search(logs: DataFrame, condition, newest: int, *tie_break) -> DataFrame:
    """The newest rows that meet a condition; a bounded top-k, not a full sort."""
    return (
        logs.filter(condition)
        .orderBy(F.desc("ts"), *[F.desc(c) for c in tie_break])
        .limit(newest)
    )


def slow_requests(logs: DataFrame, newest: int, *tie_break, over_ms: int = 2000):
    return log_search(logs, F.col("duration_ms") > over_ms, newest, *tie_break)


def failed_requests(logs: DataFrame, newest: int, *tie_break) -> DataFrame:
    return log_search(logs, F.col("status") >= 400, newest, *tie_break)


def keyword_search(logs: DataFrame, newest: int, *tie_break) -> DataFrame:
    """Errors and anything about security or authentication."""
    words = F.expr(
        "level in ('ERROR', 'CRITICAL') or event like '%security%'"
        " or event like '%authentication%' or error_type like '%authentication%'"
    )
    return log_search(logs, words, newest, *tie_break)


def top_sources(
    logs: DataFrame, error_type: str = "authentication_failed", n: int = 10
) -> DataFrame:
    """Remote addresses with most failures; ties by address."""
    return (
        logs.filter(F.col("error_type") == error_type)
        .groupBy("remote_ip")
        .agg(F.count("*").alias("n_failures"))
        .orderBy(F.desc("n_failures"), "remote_ip")
        .limit(n)
    )
