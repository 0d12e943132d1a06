import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from mailrisk.plans.catalog import QUERIES
from oracle.catalog import ORACLES

from conftest import SF

# one per family; the whole registry is compared by the driver at a larger scale
CHECKED = [
    "parse_eml_files", "typed_ingest_lines", "check_verdict_rows", "html_to_text", "redact_placeholder", "redaction_ledger",
    "safe_snippets", "parse_headers", "received_anomalies", "registered_domain", "url_findings_intel", "signal_descriptions",
    "evidence_text", "policy_verdict", "export_metrics_table", "availability_10m", "sustained_alert", "category_pass_rate",
    "metrics_stream_rows", "alerts_stream_rows", "service_alerts", "service_alerts_stream", "availability_stream", "low_volume_stream",
    "reviewed_stream_rows", "corrections_stream_rows", "classify_mail_tables", "classify_mail_intel", "lookalike_hosts", "answered_mail",
    "latency_sketch", "read_log_fields", "judge_mail_files", "review_several", "brand_domain_table",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_an_oracle():
    """The training-data operators have tests of their own where SQL cannot express them."""
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert {r.label for r in contract.entry(spark).collect()} == {"phishing", "sospechoso", "seguro"}


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    mine = contract.queries()[name](spark, SF).toPandas()
    sql = duck.execute(contract.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    columns = sorted(mine.columns)

    def rows(frame):
        return sorted(map(str, frame[columns].itertuples(index=False, name=None)))

    assert rows(mine.astype(str)) == rows(sql.astype(str))
