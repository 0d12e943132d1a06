"""The service's own alert rules, evaluated at regular times and held.

Every condition is made of sums, so logs and gauges are aggregated once to buckets
of one step; windows of any width are then sums of buckets.  A P95 above a limit is
the share of slower requests exceeding five percent.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions.verdict import canonical_label
from mailrisk.operators import alerts, monitor

SLOW_SHARE = 0.05


def log_sums() -> dict:
    classify = F.col("endpoint") == "/classify"
    reviewer = F.col("component") == "reviewer"
    failed = monitor.is_5xx()
    return {
        "n_all": F.count("*"),
        "n_5xx": F.count_if(failed),
        "n_internal": F.count_if(F.col("error_type") == "internal_error"),
        "n_auth": F.count_if(F.col("error_type") == "authentication_failed"),
        "n_classify": F.count_if(classify),
        "n_classify_slow": F.count_if(classify & (F.col("duration_ms") > rules.SLO_LATENCY_MS)),
        "n_classified": F.count_if(monitor.classified()),
        "n_phishing": F.count_if(canonical_label(F.col("classification")) == "phishing"),
        "n_reviews": F.count_if(reviewer),
        "n_reviews_failed": F.count_if(reviewer & (failed | (F.col("level") == "ERROR"))),
        "n_reviews_slow": F.count_if(reviewer & (F.col("duration_ms") > 10000)),
    }


def gauge_sums() -> dict:
    def of(metric):
        return F.when(F.col("metric") == metric, F.col("value"))

    return {
        "n_down": F.count_if((F.col("metric") == "up") & (F.col("value") == 0)),
        "cpu_sum": F.sum(of("cpu_pct")),
        "cpu_n": F.count(of("cpu_pct")),
        "used": F.sum(of("memory_used")),
        "used_n": F.count(of("memory_used")),
        "limit": F.sum(of("memory_limit")),
        "limit_n": F.count(of("memory_limit")),
        "n_restarts": F.sum(of("restarts")),
        "n_failed": F.sum(of("deployment_failed")),
    }


def _share(part, whole):
    return monitor.percent(part, whole)


def _mean(total, n):
    return F.when(n > 0, total / n)


def seconds_of(rule: str) -> int:
    """Width of a rule's window."""
    return alerts.step_seconds(rules.ALERT_RULES[rule][0])


def log_conditions() -> dict:
    """Condition of each log rule, a function of ``of``, which gives a sum of the rule's window by name."""
    slow = SLOW_SHARE * 100

    def per_second(count, rule):
        return lambda of: of(count) / seconds_of(rule)

    def available(of):
        return _share(of("n_all") - of("n_5xx"), of("n_all"))

    return {
        "high_latency": lambda of: _share(of("n_classify_slow"), of("n_classify")) > slow,
        "low_availability": lambda of: available(of) < rules.SLO_AVAILABILITY_PCT,
        "high_error_rate": lambda of: _share(of("n_5xx"), of("n_all")) > 5,
        "critical_error_rate": lambda of: _share(of("n_5xx"), of("n_all")) > 15,
        "internal_errors": lambda of: per_second("n_internal", "internal_errors")(of) > 0.1,
        "reviewer_errors": lambda of: per_second("n_reviews_failed", "reviewer_errors")(of) > 0.05,
        "reviewer_latency": lambda of: _share(of("n_reviews_slow"), of("n_reviews")) > slow,
        "auth_failures": lambda of: per_second("n_auth", "auth_failures")(of) > 1,
        "possible_attack": lambda of: per_second("n_auth", "possible_attack")(of) > 10,
        "low_volume": lambda of: of("n_classified") / (seconds_of("low_volume") / 60) < 5,
        "high_phishing_share": lambda of: _share(of("n_phishing"), of("n_classified")) > 25,
    }


def gauge_conditions() -> dict:
    def memory(of):
        return _mean(of("used"), of("used_n")) / _mean(of("limit"), of("limit_n")) * 100

    return {
        "service_down": lambda of: of("n_down") > 0,
        "high_cpu": lambda of: _mean(of("cpu_sum"), of("cpu_n")) > 80,
        "high_memory": lambda of: memory(of) > 85,
        "frequent_restarts": lambda of: of("n_restarts") > 3,
        "failed_deployment": lambda of: of("n_failed") > 0,
    }


def _read_by(condition) -> set[str]:
    """The sums that a condition looks at."""
    names = set()

    def of(name):
        names.add(name)
        return F.col(name)

    condition(of)
    return names


def _judged(rows: DataFrame, sums: dict, conditions: dict, step: str, series) -> DataFrame:
    """``series, day, ts, checks`` at every step of each series, each over the windows that end there.

    Rows are aggregated once, to buckets of one step; empty steps come from a calendar, and every width is a frame
    over the two together.  A day of a series is a task's work, with the buckets of the evening before.
    """
    named = rows.withColumn("series", series)
    buckets = monitor.tumbling(named, step, "series", **sums).select(
        "series", F.col("window_start").cast("timestamp").alias("ts"), *[F.coalesce(n, F.lit(0)).alias(n) for n in sums], F.lit(False).alias("tick")
    )
    steps = monitor.row_calendar(named, step, "series").select(
        "series", F.col("window_start").cast("timestamp").alias("ts"), *[F.lit(0).alias(n) for n in sums], F.lit(True).alias("tick")
    )
    every, widest = alerts.step_seconds(step), max(map(seconds_of, conditions))
    later = F.col("ts") + F.expr(f"interval {widest - every} seconds")
    days = F.array(F.date_trunc("day", "ts"), F.date_trunc("day", later))
    rows = buckets.unionByName(steps).withColumn("at", F.unix_seconds("ts"))
    rows = rows.withColumn("day", F.explode(F.when(F.col("tick"), F.slice(days, 1, 1)).otherwise(F.array_distinct(days))))
    wanted = sorted({(seconds_of(rule), name) for rule, c in conditions.items() for name in _read_by(c)})

    def over(width):
        return Window.partitionBy("series", "day").orderBy("at").rangeBetween(-(width - every), 0)

    summed = rows.select("series", "day", "ts", "tick", *[F.sum(n).over(over(w)).alias(f"{n}_{w}") for w, n in wanted])
    checks = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.coalesce(condition(lambda name, w=seconds_of(rule): F.col(f"{name}_{w}")), F.lit(False)).alias("breach"),
        )
        for rule, condition in conditions.items()
    ]
    return summed.where("tick").select("series", "day", "ts", F.array(*checks).alias("checks"))


def _tables(logs: DataFrame, gauges: DataFrame | None, step: str) -> list[DataFrame]:
    judged = [_judged(logs, log_sums(), log_conditions(), step, F.lit("all"))]
    if gauges is not None:
        judged.append(_judged(gauges, gauge_sums(), gauge_conditions(), step, F.col("instance")))
    return judged


def service_ticks(
    logs: DataFrame, gauges: DataFrame | None = None, step: str = "1 minute"
) -> DataFrame:
    """``rule, series, ts, breach`` of all rules; a tick closes at ``ts + step``.

    Widths are multiples of ``step``, and at most a day.  Gauge rules need the gauge table and are judged for
    each instance, the others over all log rows.
    """
    parts = [judged.select("series", "ts", F.explode("checks").alias("c")) for judged in _tables(logs, gauges, step)]
    return reduce(DataFrame.unionByName, parts).select("c.rule", "series", "ts", "c.breach")


def service_alerts(
    logs: DataFrame, gauges: DataFrame | None = None, step: str = "1 minute"
) -> DataFrame:
    """Alerts that fired, with severity, after their rule's hold time.

    A tick's checks are compared with those before it where they are made, so only changes leave a day.
    """
    by_day = Window.partitionBy("series", "day").orderBy("ts")
    parts = []
    for judged in _tables(logs, gauges, step):
        before, after = F.lag("checks").over(by_day), F.lead("checks").over(by_day)
        changed = F.filter(
            F.arrays_zip(F.col("checks").alias("now"), F.col("before").alias("before")),
            lambda c: F.col("edge") | (c["now"]["breach"] != c["before"]["breach"]),
        )
        marked = judged.withColumns({"edge": before.isNull() | after.isNull(), "before": F.coalesce(before, F.col("checks"))})
        parts.append(marked.select("series", "ts", F.explode(changed).alias("c")).select("c.now.rule", "series", "ts", "c.now.breach"))
    fired = alerts.fired_alerts(reduce(DataFrame.unionByName, parts), rule_holds(), step)
    return fired.withColumn("severity", severity(F.col("rule")))


def rule_holds() -> dict[str, int]:
    return {rule: alerts.step_seconds(hold) for rule, (_, hold, _) in rules.ALERT_RULES.items()}


def severity(rule):
    levels = [F.lit(part) for name, (_, _, level) in rules.ALERT_RULES.items() for part in (name, level)]
    return F.create_map(*levels)[rule]
