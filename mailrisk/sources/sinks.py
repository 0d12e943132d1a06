"""Verdict, file and metric sinks."""

import os
import shutil

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk import rules


def write_verdicts(
    verdicts: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Verdict rows with nested evidence, one folder per label.

    Three labels only: writers keep their input partitions and open one file per
    label, so a label with most of the rows is not squeezed into one task.
    """
    verdicts.write.mode(mode).partitionBy("label").format(fmt).save(path)


def answer_sink(path: str):
    """A ``foreachBatch`` function that keeps what was answered apart from what was rejected.

    One pass writes both branches below a folder of the batch's number, replacing what an earlier try
    of that batch has left, so a batch that is run again changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rejected = F.col("status") == "invalid_request"
        branch = F.when(rejected, "rejected").otherwise("answered")
        batch.withColumn("branch", branch).write.mode("overwrite").partitionBy("branch").parquet(f"{path}/batch={batch_id}")

    return write


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder's plain path if it is in the file system of the machine, or one mounted there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return folder.toUri().getPath() if system.getUri().getScheme() == "file" else None


def _local_writer(folder: str, key: str):
    """A function that writes batches of numbers and bytes, for `mapInArrow`; gives the number of files.

    A try of a task has a folder of its own, which readers skip for its name; the first try that ends gives
    it the task's name, others are thrown away.
    """

    def run(batches):
        context = TaskContext.get()
        own = f"{folder}/_tries/{context.taskAttemptId()}"
        n = 0
        for batch in batches:
            os.makedirs(own, exist_ok=True)
            for number, value in zip(*batch.columns, strict=True):
                with open(f"{own}/{key}={number}.{n}.txt", "xb") as file:
                    file.write(value.as_buffer())
                    file.write(b"\n")
                n += 1
        if n:
            done = f"{folder}/part-{context.partitionId():05d}"
            try:
                os.rename(own, done)
            except OSError:
                if not os.path.isdir(done):
                    raise
                shutil.rmtree(own)
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return run


def write_files(rows: DataFrame, path: str) -> None:
    """Every row as a text file of its own below the new folder ``path``.

    Takes a whole number, whose column and value are in the file's path, and ``value``.  Spark's writer makes
    a folder for each number and moves them one by one when all are written; Hadoop's local file system
    starts processes for every file too.  So tasks write local files themselves.
    """
    spark, key = rows.sparkSession, rows.columns[0]
    folder = _local_folder(spark, path)
    if folder is None:
        rows.write.option("maxRecordsPerFile", 1).partitionBy(key).text(path)
        return
    os.makedirs(folder)
    number = F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    content = F.coalesce("value", F.lit("")).cast("binary")
    rows.select(number, content).mapInArrow(_local_writer(folder, key), "files long").write.format("noop").mode("overwrite").save()


def export_metrics(logs: DataFrame) -> DataFrame:
    """Counters and the duration histogram as ``metric, labels, value`` rows.

    One aggregation over the finest label combination; everything exported is a
    re-aggregation of that small table's columns.
    """
    seconds = F.col("duration_ms") / 1000
    bounds = [*rules.DURATION_BUCKETS, float("inf")]
    fine = logs.groupBy(
        "method", "endpoint", "status", "classification", "error_type"
    ).agg(
        F.count("*").alias("n"),
        F.count("duration_ms").alias("n_timed"),
        F.sum(F.col("duration_ms")).alias("ms"),
        *[F.count_if(seconds <= b).alias(f"le_{i}") for i, b in enumerate(bounds)],
    )

    def label(**parts):
        pairs = []
        for name, value in parts.items():
            pairs += [F.lit(name), value.cast("string")]
        return F.create_map(*pairs)

    def shown_bound(b):
        return "+Inf" if b == float("inf") else str(b)

    no_labels = F.create_map().cast("map<string,string>")
    samples = F.array(
        F.struct(
            F.lit("requests_total").alias("metric"),
            label(
                method=F.col("method"), endpoint=F.col("endpoint"), status=F.col("status")
            ).alias("labels"),
            F.col("n").cast("double").alias("value"),
        ),
        F.struct(
            F.lit("classifications_total").alias("metric"),
            label(classification=F.col("classification")).alias("labels"),
            F.when(F.col("classification").isNotNull(), F.col("n")).cast("double").alias(
                "value"
            ),
        ),
        F.struct(
            F.lit("errors_total").alias("metric"),
            label(error_type=F.col("error_type")).alias("labels"),
            F.when(F.col("error_type").isNotNull(), F.col("n")).cast("double").alias(
                "value"
            ),
        ),
        *[
            F.struct(
                F.lit("request_duration_seconds_bucket").alias("metric"),
                label(le=F.lit(shown_bound(b))).alias("labels"),
                F.col(f"le_{i}").cast("double").alias("value"),
            )
            for i, b in enumerate(bounds)
        ],
        F.struct(
            F.lit("request_duration_seconds_sum").alias("metric"),
            no_labels.alias("labels"),
            (F.col("ms") / 1000).alias("value"),
        ),
        F.struct(
            F.lit("request_duration_seconds_count").alias("metric"),
            no_labels.alias("labels"),
            F.col("n_timed").cast("double").alias("value"),
        ),
    )
    # maps cannot be grouped; their entries can
    return (
        fine.select(F.explode(samples).alias("s"))
        .select("s.metric", F.map_entries("s.labels").alias("entries"), "s.value")
        .filter(F.col("value").isNotNull())
        .groupBy("metric", "entries")
        .agg(F.sum("value").alias("value"))
        .select("metric", F.map_from_entries("entries").alias("labels"), "value")
    )
