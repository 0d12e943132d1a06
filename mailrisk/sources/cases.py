"""Labelled cases."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.operators.validate import fill_defaults
from mailrisk.schemas import CASE_CATEGORIES, CASE_SUITE


def explode_cases(suites: DataFrame) -> DataFrame:
    """Suites hold one array of cases per category; give one row per case."""
    per_category = [
        suites.select(F.lit(c).alias("category"), F.explode(c).alias("case"))
        for c in CASE_CATEGORIES
    ]
    rows = reduce(DataFrame.unionByName, per_category)
    return rows.select(
        "category",
        "case.name",
        F.col("case.classification").alias("expected_label"),
        "case.expected_score",
        "case.request",
        "case.expected_reasons",
    )


def read_cases(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Case suites from JSON: one suite per file, or per line."""
    suites = (
        spark.read.schema(CASE_SUITE).option("multiLine", multi_line).json(path)
    )
    return explode_cases(suites)


def case_messages(cases: DataFrame) -> DataFrame:
    """The requests of cases as messages; a case is known by its name."""
    request = F.col("request")
    return fill_defaults(
        cases.select(
            F.col("name").alias("message_id"),
            request["raw_headers"].alias("raw_headers"),
            request["raw_html"].alias("raw_html"),
            request["text_body"].alias("text_body"),
            request["attachments_meta"].alias("attachments"),
            request["account_context"].alias("context"),
        )
    )
