"""Time the headline queries; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from mailrisk.plans.catalog import QUERIES
from mailrisk.session import build_session

HEADLINE = [
    "label_distribution",
    "classify_mail",
    "redact_text",
    "redaction_ledger",
    "header_score",
    "url_findings",
    "url_findings_intel",
    "classify_mail_intel",
    "text_score",
    "html_to_text",
    "safe_snippets",
    "policy_verdict",
    "category_pass_rate",
    "threshold_sweep",
    "request_counts",
    "duration_histogram",
    "latency_quantiles",
    "availability_10m",
    "error_rate",
    "phishing_share",
    "sustained_alert",
    "service_alerts",
    "monthly_slo",
    "export_metrics_table",
    "classify_stream_rows",
    "metrics_stream_rows",
    "service_alerts_stream",
    "answered_mail",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the tables are single row groups, which one task reads; a large input has many splits
    split = f"{tempfile.mkdtemp(prefix='bench-')}/{os.path.basename(sf_dir.rstrip('/'))}"
    for name in sorted(os.listdir(sf_dir)):
        spark.read.parquet(f"{sf_dir}/{name}").repartition(3 * int(cpus)).write.parquet(f"{split}/{name}")
    sf_dir = split
    QUERIES["request_counts"](spark, sf_dir).collect()  # start the JVM's machinery
    seconds = {}
    for name in HEADLINE:
        counted = Observation()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).observe(counted, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        # a query that reads nothing is no fast one
        assert counted.get["rows"] > 0, name
    messages = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "messages_per_sec": round(messages / seconds["classify_mail"], 1),
                "events_per_sec": round(events / seconds["error_rate"], 1),
                "config": f"local[{cpus}], Spark {spark.version}, tables in {3 * int(cpus)} files",
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
