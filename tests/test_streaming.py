import datetime
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from mailrisk.operators import alerts, service_rules
from mailrisk.plans.classify import answers, classify
from mailrisk.plans.queries import drained
from mailrisk.plans.views import log_view, mail_view
from mailrisk.session import stateful
from mailrisk.sources.sinks import answer_sink
from mailrisk.streaming.stateful import alerts_stream, sliding_stream
from mailrisk.streaming.streams import classify_stream, metrics_stream, service_alerts_stream, step_buckets

from conftest import SF


def as_stream(rows, path, files):
    """Write rows in several files and read them back one file per trigger."""
    rows.repartition(files).write.parquet(path)
    spark = rows.sparkSession
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_verdicts_equal_batch_and_redelivery_is_dropped(spark, tmp_path):
    mail = mail_view(spark, SF).withColumn("received_at", F.timestamp_seconds(F.col("message_id") + 1704067200))
    twice = mail.unionByName(mail.filter("message_id % 3 = 0"))
    stream = classify_stream(as_stream(twice, str(tmp_path / "in"), 3))
    got = drained(stream, "verdicts").select("message_id", "label", "risk_score")
    expected = classify(mail).select("message_id", "label", "risk_score")
    assert got.exceptAll(expected).count() == 0 and got.count() == expected.count()


def test_metrics_stream_drops_late_rows(spark, tmp_path):
    path = str(tmp_path / "logs")
    logs = log_view(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    logs.coalesce(1).write.parquet(path)
    logs.orderBy(F.desc("ts")).limit(1).coalesce(1).write.mode("append").parquet(path)
    stream = metrics_stream(
        spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(path), "1 hour")
    rows = drained(stream, "metrics")
    closed = rows.agg(F.sum("n_requests").alias("n"), F.max("window_end").alias("last")).first()
    assert closed.n == logs.filter(F.col("ts") < F.lit(closed.last)).count()
    # a third drop comes when the watermark of the first has taken effect
    for name in os.listdir(path):  # files are read in the order of their age
        os.utime(f"{path}/{name}", (1e9, 1e9))
    late = logs.limit(5).withColumn("ts", F.lit("2020-01-01").cast("timestamp"))
    late.coalesce(1).write.mode("append").parquet(path)
    again = drained(
        metrics_stream(spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(path), "1 hour"),
        "metrics")
    assert again.filter("window_start < '2021-01-01'").count() == 0


def as_ticks(stream):
    return stream.withColumn("closes", F.col("ts") + F.expr("interval 1 minute") - F.expr("interval 1 microsecond")).withWatermark("closes", "3 minutes")


def changes_of(states):
    """``(series, ts, state)`` wherever the state of a series changes."""
    expected = set()
    for series, part in states.groupby("series"):
        before = "inactive"
        for ts, state in zip(part["ts"], part["state"]):
            if state != before:
                expected.add((series, ts.to_pydatetime(), state))
            before = state
    return expected


@pytest.mark.parametrize("files", [1, 4])
def test_alert_stream_equals_batch_states(spark, tmp_path, files):
    """Ticks come in any order within a file; what the watermark has passed equals the batch."""
    start = datetime.datetime(2024, 1, 1)
    flags = [i % 7 != 0 and i % 11 != 5 for i in range(60)]
    rows = [("r", s, start + datetime.timedelta(minutes=i), f if s == "x" else not f) for s in "xy" for i, f in enumerate(flags)]
    ticks = spark.createDataFrame(rows, "rule string, series string, ts timestamp, breach boolean")
    path = str(tmp_path / "ticks")
    for part in range(files):
        size = 60 // files
        lo, hi = start + datetime.timedelta(minutes=part * size), start + datetime.timedelta(minutes=(part + 1) * size)
        inside = ticks.filter((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi)))
        inside.orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(path)
    for age, name in enumerate(sorted(os.listdir(path), key=lambda n: os.path.getmtime(f"{path}/{n}"))):
        os.utime(f"{path}/{name}", (1e9 + age, 1e9 + age))
    stream = stateful(spark).readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drained(alerts_stream(as_ticks(stream), {"r": 180}, 60), "alerts")
    states = alerts.alert_states(ticks, {"r": 180}, "1 minute").where("ts <= '2024-01-01 00:55:00'").toPandas().sort_values("ts")
    assert {(r.series, r.ts, r.state) for r in got.collect()} == changes_of(states)


def test_service_alert_stream_with_gap_late_rows_and_two_instances(spark, tmp_path):
    """Logs and gauges in several files, some rows late by minutes; an hour of silence in between."""
    minute = (F.col("id") / 4).cast("int")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 15)
    ids = spark.range(1600).where("id not between 500 and 740")
    logs = ids.select(
        at.alias("ts"), F.lit("/classify").alias("endpoint"), F.when(F.col("id") % 11 < 3, 500).otherwise(200).alias("status"),
        (F.col("id") % 50 * 70).cast("bigint").alias("duration_ms"), F.when(F.col("id") % 13 == 0, "authentication_failed").alias("error_type"),
        F.lit("reviewer").alias("component"), F.lit("INFO").alias("level"),
        F.when(minute % 40 < 20, F.when(F.col("id") % 2 == 0, "phishing").otherwise("safe")).alias("classification"),
    )
    gauges = ids.select(
        at.alias("ts"), F.when(F.col("id") % 3 == 0, "up").otherwise("cpu_pct").alias("metric"),
        F.when(F.col("id") % 2 == 0, "i0").otherwise("i1").alias("instance"),
        F.when(F.col("id") % 3 == 0, (F.col("id") % 30 > 6).cast("double")).otherwise(F.when(minute % 60 < 35, 95.0).otherwise(10.0)).alias("value"),
    )
    streams_ = []
    for name, rows in (("logs", logs), ("gauges", gauges)):
        path = str(tmp_path / name)
        late = F.unix_seconds("ts") % 7 == 0  # these come one file later than their neighbours
        part = F.floor((F.unix_seconds("ts") - 1704067200) / 240) + late.cast("int")
        rows = rows.withColumn("part", part)
        for k in sorted(r.part for r in rows.select("part").distinct().collect()):
            rows.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
        for age, file in enumerate(sorted((f for f in os.listdir(path) if f.startswith("part")), key=lambda n: os.path.getmtime(f"{path}/{n}"))):
            os.utime(f"{path}/{file}", (1e9 + age, 1e9 + age))
        streams_.append(stateful(spark).readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 40).parquet(path))
    got = drained(service_alerts_stream(*streams_, lateness="10 minutes"), "service").collect()
    holds = service_rules.rule_holds()
    states = alerts.alert_states(service_rules.service_ticks(logs, gauges), holds, "1 minute").toPandas()
    closed = spark.range(1).select(F.date_trunc("minute", F.lit(logs.agg(F.max("ts")).first()[0]) - F.expr("interval 11 minutes"))).first()[0]
    states = states[states["ts"] <= closed].sort_values("ts")
    states["series"] = list(zip(states["rule"], states["series"]))
    assert {((r.rule, r.series), r.ts, r.state) for r in got} == changes_of(states)
    assert {r.series for r in got} == {"all", "i0", "i1"} and {"firing", "pending", "inactive"} == {r.state for r in got}


def test_streams_read_files_and_folders_alike(spark, tmp_path):
    """A table may be one file or a folder of files."""
    folder = tmp_path / "tables"
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(5).write.parquet(f"{folder}/{name}.parquet")
    for name in ("metrics_stream_rows", "classify_stream_rows", "alerts_stream_rows", "availability_stream"):
        one, many = (contract.queries()[name](spark, d).collect() for d in (SF, str(folder)))
        assert len(one) > 100 and sorted(map(str, one)) == sorted(map(str, many)), name


def test_sliding_windows_of_a_stream(spark, tmp_path):
    """Empty steps have windows as well; sums equal a plain loop."""
    step, widths = 60, [60, 300]
    rows = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), s % 5) for s in [*range(0, 1800, 37), *range(5400, 9000, 53)]]
    table = spark.createDataFrame(rows, "ts timestamp, v int")
    stream = as_stream(table, str(tmp_path / "in"), 1)
    buckets = step_buckets(stream, "1 minute", F.lit("all"), "1 minute", {"v": F.sum("v")})
    got = drained(sliding_stream(buckets, ["v"], widths, step, "series"), "windows").collect()
    t0 = datetime.datetime(2024, 1, 1)
    found = {(r.width, int((r.window_start - t0).total_seconds())): r.v for r in got}
    last = max(s for _, s in found)
    assert last >= 8700 and len(found) == 2 * (last // 60 + 1)
    for (width, start), value in found.items():
        inside = [v for ts, v in rows if start + step - width <= (ts - t0).total_seconds() < start + step]
        assert value == sum(inside)


def test_answers_are_written_once_per_batch(spark, tmp_path):
    mail = mail_view(spark, SF)
    stream = as_stream(mail, str(tmp_path / "in"), 3)
    out = str(tmp_path / "out")
    sink = answer_sink(out)

    def twice(batch, number):  # as after a failure between the sink and the log
        sink(batch, number)
        sink(batch, number)

    run = answers(stream).writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == mail.count() == rows.select("message_id").distinct().count()
    assert {r.branch for r in rows.where("status = 'invalid_request'").collect()} == {"rejected"}
