import datetime
import random

import pytest
from pyspark.sql import functions as F

from mailrisk.operators import alerts, evaluate, monitor

T0 = datetime.datetime(2024, 1, 1)
LOG = (
    "ts timestamp, level string, event string, method string, endpoint string, status int, duration_ms long,"
    " error_type string, component string, classification string, risk_score int, remote_ip string"
)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


@pytest.fixture
def logs(spark):
    """Log rows from (minute, status, duration, error type, label)."""

    def build(rows):
        return spark.createDataFrame(
            [
                (at(m), "ERROR" if e else "INFO", "x", "POST", "/classify", s, d, e, "api", label, 10, f"10.0.0.{int(m) % 3}")
                for m, s, d, e, label in rows
            ],
            LOG,
        )

    return build


def random_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        status = rng.choice([200, 200, 200, 400, 401, 500])
        error = {400: "invalid_request", 401: "authentication_failed", 500: "internal_error"}.get(status)
        label = rng.choice(["phishing", "sospechoso", "seguro", "malicious"]) if status == 200 else None
        rows.append((rng.uniform(0, 180), status, rng.randint(0, 4000), error, label))
    return rows


def windows(rows, width, slide):
    """Brute force: (start minute) -> rows of every window that holds a row."""
    found = {}
    for row in rows:
        start = int(row[0] // slide) * slide
        while start > row[0] - width:
            found.setdefault(start, []).append(row)
            start -= slide
    return found


def minute(ts):
    return (ts - T0).total_seconds() / 60


def test_availability_over_sliding_windows(logs):
    rows = random_rows(400, 1)
    got = {minute(r.window_start): r for r in monitor.availability(logs(rows)).collect()}
    expected = windows(rows, 10, 1)
    assert set(got) == set(expected)
    for start, inside in expected.items():
        share = 100 * sum(r[1] < 500 for r in inside) / len(inside)
        assert got[start].availability_pct == pytest.approx(share) and got[start].breach == (share < 99.5)


def test_error_rate_severity(logs):
    rows = random_rows(300, 2)
    got = {minute(r.window_start): r for r in monitor.error_rate(logs(rows)).collect()}
    for start, inside in windows(rows, 5, 5).items():
        share = 100 * sum(r[1] >= 500 for r in inside) / len(inside)
        assert got[start].severity == ("critical" if share > 15 else "warning" if share > 5 else "ok")
        assert got[start].n_4xx == sum(400 <= r[1] < 500 for r in inside)


def test_phishing_share_uses_canonical_labels(logs):
    rows = random_rows(300, 3)
    got = {minute(r.window_start): r for r in monitor.phishing_share(logs(rows)).collect()}
    for start, inside in windows([r for r in rows if r[4]], 10, 1).items():
        share = 100 * sum(r[4] in ("phishing", "malicious") for r in inside) / len(inside)
        assert got[start].phishing_pct == pytest.approx(share)


def test_quantiles_and_histogram(logs):
    data = logs([(0, 200, d, None, None) for d in [4, 5, 6, 100, 9000]])
    row = monitor.latency_quantiles(data).first()
    assert (row.p50, row.n_requests) == (6.0, 5) and row.p99 > 8000
    table = {r.le: r.n for r in monitor.duration_histogram(data).collect()}
    assert (table["0.005"], table["0.01"], table["0.1"], table["10.0"], table["+Inf"]) == (2, 3, 4, 5, 5)


def test_low_volume_sees_empty_windows(logs):
    got = monitor.low_volume(logs([(5, 200, 1, None, "seguro")] * 60 + [(45, 200, 1, None, "seguro")])).orderBy("window_start").collect()
    assert [r.per_minute for r in got] == [6.0, 0.0, 0.0, 0.0, 0.1] and [r.breach for r in got] == [False] + [True] * 4


def test_auth_failures_and_sources(logs):
    data = logs([(0.5, 401, 1, "authentication_failed", None)] * 100 + [(1.5, 401, 1, "authentication_failed", None)] * 5)
    got = monitor.auth_failures(data, "1 minute", per_second=1.0).orderBy("window_start").collect()
    assert [(r.n_failures, r.breach) for r in got] == [(100, True), (5, False)]
    assert [(r.remote_ip, r.n_failures) for r in monitor.top_sources(data).collect()] == [("10.0.0.0", 100), ("10.0.0.1", 5)]


def test_monthly_slo(logs):
    rows = [(0, 200, 100, None, None)] * 990 + [(1, 500, 3000, "internal_error", None)] * 10
    row = monitor.monthly_slo(logs(rows)).first()
    assert (row.month, row.availability_pct, row.availability_met, row.latency_met) == ("2024-01", 99.0, False, True)
    assert row.budget_left == pytest.approx(-1.0)


def test_gauges(spark):
    rows = [(at(0), "up", "a", 0.0), (at(0), "cpu_pct", "a", 90.0), (at(1), "cpu_pct", "a", 75.0), (at(1), "memory_used", "a", 9.0),
            (at(1), "memory_limit", "a", 10.0), (at(2), "restarts", "a", 4.0), (at(2), "uptime_check", "a", 1.0), (at(2), "deployment_failed", "a", 0.0)]
    row = monitor.gauge_alerts(spark.createDataFrame(rows, "ts timestamp, metric string, instance string, value double")).first()
    assert (row.service_down, row.high_cpu, row.high_memory, row.frequent_restarts, row.failed_deployment, row.unreachable) == (
        True, True, True, True, False, False)


def brute_states(flags, hold, step):
    states, since = [], None
    for i, flag in enumerate(flags):
        since = None if not flag else i if since is None else since
        held = None if since is None else (i - since) * step
        states.append("inactive" if held is None else "firing" if held >= hold else "pending")
    return states


@pytest.fixture
def ticks(spark):
    def build(series, step):
        rows = [(rule, name, at(i * step), flag) for (rule, name), flags in series.items() for i, flag in enumerate(flags)]
        return spark.createDataFrame(rows, "rule string, series string, ts timestamp, breach boolean")

    return build


def test_sustained_alerts_across_days(ticks):
    rng = random.Random(4)
    series = {
        ("a", "x"): [rng.random() < 0.7 for _ in range(300)],
        ("a", "y"): [True] * 300,
        ("b", "x"): [False] * 20 + [True] * 250 + [False] * 30,
        ("b", "z"): [False] * 300,
    }
    holds = {"a": 3 * 1800, "b": 0}
    data = ticks(series, 30)
    states = {}
    for r in alerts.alert_states(data, holds, "30 minutes").orderBy("ts").collect():
        states.setdefault((r.rule, r.series), []).append(r.state)
    for key, flags in series.items():
        assert states[key] == brute_states(flags, holds[key[0]], 1800), key
    fired = alerts.sustained_alert(data, holds, "30 minutes").collect()
    long_run = [r for r in fired if (r.rule, r.series) == ("b", "x")]
    assert len(long_run) == 1 and long_run[0].since == at(20 * 30) and long_run[0].n_firing == 250
    assert [r.since for r in fired if r.series == "y"] == [T0]


def test_rule_ticks_fill_gaps(logs, spark):
    data = logs([(0, 500, 1, "internal_error", None), (3, 200, 1, None, None), (3.5, 500, 1, "internal_error", None)])
    counts = monitor.tumbling(data, "1 minute", n=F.count("*"), bad=F.count_if(monitor.is_5xx())).drop("window_end")
    rules_ = {"r": monitor.percent(F.col("bad"), F.col("n")) > 15, "silent": F.col("n") < 1}
    ticks_ = alerts.rule_ticks(counts, monitor.calendar(counts, "1 minute"), rules_).orderBy("rule", "ts").collect()
    assert [(r.rule, minute(r.ts), r.breach) for r in ticks_] == [
        ("r", 0, True), ("r", 1, False), ("r", 2, False), ("r", 3, True),
        ("silent", 0, False), ("silent", 1, True), ("silent", 2, True), ("silent", 3, False)]


def test_case_results_and_rollup(spark):
    expected = spark.createDataFrame(
        [("n1", "a", "phishing", 85), ("n2", "a", "phishing", 92), ("n3", "b", "seguro", 15), ("n4", "b", "seguro", 8)],
        "name string, category string, expected_label string, expected_score int")
    actual = spark.createDataFrame(
        [("n1", "phishing", 65, 10), ("n2", "sospechoso", 90, 4000), ("n3", "seguro", 36, 5)], "name string, label string, risk_score int, latency_ms int")
    results = evaluate.case_result(expected, actual)
    assert {r.name: r.passed for r in results.collect()} == {"n1": True, "n2": False, "n3": False, "n4": False}
    table = {r.category: (r.n_cases, r.n_passed, r.suite_ok) for r in evaluate.category_pass_rate(results).collect()}
    assert table == {"a": (2, 1, False), "b": (2, 0, False), "all": (4, 1, False)}


def test_quality_and_sweep(spark):
    rows = [("phishing", "phishing", 70.5)] * 3 + [("phishing", "seguro", 10.0)] + [("seguro", "seguro", 5.0)] * 5 + [("seguro", "phishing", 61.0)]
    judged = spark.createDataFrame(rows, "expected_label string, label string, total_score double")
    row = evaluate.quality_rates(judged).first()
    assert (row.n_fp, row.n_fn, row.fn_pct, row.fp_ok) == (1, 1, 25.0, False)
    sweep = {r.cut: r for r in evaluate.threshold_sweep(judged, 10).collect()}
    for cut, r in sweep.items():
        assert r.true_positive == sum(s >= cut and e == "phishing" for e, _, s in rows)
        assert r.false_positive == sum(s >= cut and e != "phishing" for e, _, s in rows)
    assert {r.expected_label: (r.phishing, r.seguro) for r in evaluate.confusion_matrix(judged).collect()} == {
        "phishing": (3, 1), "seguro": (1, 5)}


def test_service_rules_against_brute_force(spark, logs):
    from mailrisk import rules
    from mailrisk.operators import service_rules

    rows = random_rows(900, 6)
    data = logs(rows)
    got = {}
    for r in service_rules.service_ticks(data).collect():
        got.setdefault(r.rule, {})[minute(r.ts)] = r.breach
    assert set(got) == set(rules.ALERT_RULES) - {"service_down", "high_cpu", "high_memory", "frequent_restarts", "failed_deployment"}

    def share(part, whole):
        return 100 * len(part) / len(whole) if whole else 0

    for tick in got["low_volume"]:
        ten, five = ([r for r in rows if tick + 1 - w <= r[0] < tick + 1] for w in (10, 5))
        labelled = [r for r in ten if r[4]]
        assert got["low_volume"][tick] == (len(labelled) / 10 < 5)
        assert got["high_phishing_share"][tick] == (share([r for r in labelled if r[4] in ("phishing", "malicious")], labelled) > 25)
        assert got["critical_error_rate"][tick] == (share([r for r in five if r[1] == 500], five) > 15)
        assert got["high_latency"][tick] == (share([r for r in five if r[2] > 2000], five) > 5)
        assert got["low_availability"][tick] == bool(ten and share([r for r in ten if r[1] != 500], ten) < 99.5)
    fired = service_rules.service_alerts(data).collect()
    assert {r.severity for r in fired if r.rule == "critical_error_rate"} == {"critical"}
    assert all((r.fired_at - r.since).total_seconds() >= 60 for r in fired if r.rule == "critical_error_rate")
