"""Rows written as files of their own."""

import os

import pytest
from pyspark.sql import functions as F

from mailrisk.plans import lookup_queries
from mailrisk.plans.views import EMPTY_VARIANT
from mailrisk.sources import sinks
from mailrisk.sources.eml import read_eml


def documents(spark, path):
    rows = spark.range(80).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    rows.repartition(3).write.parquet(str(path / "documents.parquet"))


def test_mail_files_need_no_folder_each(spark, tmp_path):
    documents(spark, tmp_path)
    found = [*os.walk(lookup_queries.mail_files(spark, str(tmp_path)).removeprefix("file:"))]
    assert sum(name.endswith(".txt") for _, _, names in found for name in names) == 70
    assert len(found) < 10 and not any(name.endswith(".crc") for _, _, names in found for name in names)
    assert EMPTY_VARIANT == 7
    assert sorted(r.message_id for r in lookup_queries.read_mail_files(spark, str(tmp_path)).collect()) == [i for i in range(80) if i % 8 != 7]


def test_files_are_found_without_a_task_each(spark, tmp_path):
    documents(spark, tmp_path)
    spark.sparkContext.setJobGroup("found", "mail files")
    try:
        assert len(lookup_queries.read_eml_files(spark, str(tmp_path)).collect()) == 70
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("found") for s in tracker.getJobInfo(j).stageIds]
    assert stages and sum(s.numTasks for s in stages) < 70


ROWS = [(1, "From: ñ\n\na\r\nb\n"), (1, "From: ñ\n\na\r\nb\n"), (2, ""), (3, None), (None, "x"), (40, "Subject: s\n\n" + "y" * 5000)]


def kept(spark, path):
    rows = read_eml(spark, path, pattern="*.txt")
    number = F.regexp_extract("path", "n=([^./]+)", 1)
    return sorted(tuple(r) for r in rows.select(number.alias("n"), *rows.columns[1:]).collect())


@pytest.fixture
def other_system(spark, tmp_path):
    """A folder that only Spark's writers and readers find under its name."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.files.link./at", f"file://{tmp_path}")
    yield "viewfs://files/at/rows"
    conf.unset("fs.viewfs.mounttable.files.link./at")


def test_files_hold_rows_in_any_file_system(spark, tmp_path, other_system):
    rows = spark.createDataFrame(ROWS, "n long, value string").repartition(2)
    for path in (f"file://{tmp_path}/a", f"{tmp_path}/b", other_system):
        sinks.write_files(rows, path)
    assert sinks._local_folder(spark, other_system) is None
    assert kept(spark, f"{tmp_path}/a") == kept(spark, f"{tmp_path}/b") == kept(spark, other_system)
    held = [(tmp_path / d / f).read_bytes() for d, _, names in os.walk(tmp_path / "a") for f in names]
    assert sorted(held) == sorted(((value or "") + "\n").encode() for _, value in ROWS)


def test_no_rows(spark, tmp_path):
    sinks.write_files(spark.createDataFrame([], "n long, value string"), str(tmp_path / "none"))
    assert kept(spark, str(tmp_path / "none")) == []


def test_a_task_that_runs_twice_writes_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"a"), (2, b"b")], "n long, value binary").repartition(2)
    for _ in range(2):
        assert sum(r.files for r in rows.mapInArrow(sinks._local_writer(str(tmp_path), "n"), "files long").collect()) == 2
    assert sorted(f for _, _, names in os.walk(tmp_path) for f in names) == ["n=1.0.txt", "n=2.0.txt"]
