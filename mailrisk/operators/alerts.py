"""Sustained alerts: a condition must hold for a while before it fires."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPISODE = ["rule", "series"]


def pending_since(ticks: DataFrame) -> DataFrame:
    """Add since when the condition of a tick has held without a break.

    ``ticks`` has ``rule, series, ts, breach`` at regular times without gaps.  The
    run is found per day of a series and days are linked by one row each, so a
    series of any length is split over many tasks.
    """
    by_day = Window.partitionBy(*EPISODE, "day").orderBy("ts")
    quiet = F.when(~F.col("breach"), F.col("ts"))
    marked = (
        ticks.withColumn("day", F.date_trunc("day", "ts"))
        .withColumn(
            "quiet_today",
            F.max(quiet).over(by_day.rowsBetween(Window.unboundedPreceding, 0)),
        )
    )
    days = ticks.groupBy(*EPISODE, F.date_trunc("day", "ts").alias("day")).agg(
        F.max(quiet).alias("last_quiet"), F.min("ts").alias("first_ts")
    )
    series = Window.partitionBy(*EPISODE)
    earlier = series.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    linked = days.select(
        *EPISODE,
        "day",
        F.max("last_quiet").over(earlier).alias("quiet_before"),
        F.min("first_ts").over(series).alias("first_ts"),
    )
    return (
        marked.join(linked, [*EPISODE, "day"], "left")
        .withColumn("last_quiet", F.coalesce("quiet_today", "quiet_before"))
        .drop("day", "quiet_today", "quiet_before")
    )


def alert_states(ticks: DataFrame, holds: dict[str, int], step: str) -> DataFrame:
    """State of every tick: inactive, pending or firing.

    ``holds`` gives each rule's hold time in seconds.  A run that is not preceded
    by a quiet tick began with its series.
    """
    pairs = [F.lit(part) for item in holds.items() for part in item]
    hold = F.create_map(*pairs)[F.col("rule")]
    began = F.coalesce(F.col("last_quiet") + F.expr(f"interval {step}"), F.col("first_ts"))

    def unix(ts):
        return F.unix_seconds(ts.cast("timestamp"))

    return (
        pending_since(ticks)
        .withColumn("since", F.when(F.col("breach"), began))
        .withColumn(
            "state",
            F.when(~F.col("breach"), "inactive")
            .when(unix(F.col("ts")) - unix(F.col("since")) >= hold, "firing")
            .otherwise("pending"),
        )
        .select(*EPISODE, "ts", "breach", "since", "state")
    )


def sustained_alert(ticks: DataFrame, holds: dict[str, int], step: str) -> DataFrame:
    """One row per alert that fired: when it began, fired, and was last true.

    Within each day of a series only the ticks where the condition changes go on, with the day's first and
    last tick; holds are then arithmetic on the intervals between them.
    """
    by_day = Window.partitionBy(*EPISODE, F.date_trunc("day", "ts")).orderBy("ts")
    edge = F.lag("breach").over(by_day).isNull() | F.lead("breach").over(by_day).isNull()
    changed = F.lag("breach").over(by_day) != F.col("breach")
    kept = ticks.withColumn("kept", edge | changed).where("kept").drop("kept")
    return fired_alerts(kept, holds, step)


def fired_alerts(changes: DataFrame, holds: dict[str, int], step: str) -> DataFrame:
    """Alerts from ``rule, series, ts, breach`` where conditions change, and first and last ticks of days.

    Rows that change nothing do no harm; a series has as many rows as its condition has changes, and two a day.
    """
    pairs = [F.lit(part) for item in holds.items() for part in item]
    hold, every = F.create_map(*pairs)[F.col("rule")], step_seconds(step)
    series = Window.partitionBy(*EPISODE)
    in_order = series.orderBy("at")
    before = F.lag("breach").over(in_order)
    runs = (
        changes.withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
        .withColumn("final", F.max("at").over(series))
        .withColumn("turns", before.isNull() | (before != F.col("breach")))
        .where("turns")
        .withColumn("last_at", F.coalesce(F.lead("at").over(in_order) - every, F.col("final")))
        .where("breach")
    )
    fires = F.col("at") + F.ceil(hold / every) * every
    return runs.withColumn("fires", fires).where(F.col("fires") <= F.col("last_at")).select(
        *EPISODE,
        F.timestamp_seconds("at").alias("since"),
        F.timestamp_seconds("fires").alias("fired_at"),
        F.timestamp_seconds("last_at").alias("last_true"),
        (F.expr(f"(last_at - fires) div {every}") + 1).alias("n_firing"),
    )


def step_seconds(width: str) -> int:
    """Seconds of an interval text such as ``5 minutes``."""
    number, unit = width.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def rule_ticks(counts: DataFrame, times: DataFrame, rules: dict, series=None) -> DataFrame:
    """Evaluate conditions on windowed counts at every calendar time.

    ``rules`` maps a rule name to a condition on the columns of ``counts``.  A window without
    rows counts as zero before the conditions are looked at, so silence can breach; a condition
    that is null does not hold.
    """
    series = F.lit("all") if series is None else series
    evaluated = times.join(counts, "window_start", "left").fillna(0)
    conditions = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.coalesce(condition, F.lit(False)).alias("breach"),
            )
            for name, condition in rules.items()
        ]
    )
    return evaluated.select(
        series.alias("series"), F.col("window_start").alias("ts"), F.explode(conditions).alias("c")
    ).select("c.rule", "series", "ts", "c.breach")
