import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailrisk.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Apply a Column function to single values: ``values(fn, [v, …]) -> list``."""

    def run(function, inputs, kind="string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame(
            [(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}"
        )
        out = rows.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
        return [row.r for row in out]

    return run


MESSAGE_DDL = (
    "message_id bigint, raw_headers string, raw_html string, text_body string,"
    " attachments array<struct<filename:string,mime:string,size:bigint,hash:string>>,"
    " context struct<user_locale:string,trusted_senders:array<string>,owned_domains:array<string>>"
)


@pytest.fixture
def messages(spark):
    """Message rows from keyword dictionaries."""

    def build(*rows):
        return spark.createDataFrame(
            [
                (
                    i,
                    r.get("headers", ""),
                    r.get("html", ""),
                    r.get("text", ""),
                    r.get("attachments"),
                    r.get("context"),
                )
                for i, r in enumerate(rows)
            ],
            MESSAGE_DDL,
        )

    return build
