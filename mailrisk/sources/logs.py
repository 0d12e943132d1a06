"""Service logs: JSON lines to a typed table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from mailrisk.schemas import LOG


# The service's keys for columns that the log table names otherwise.
SERVICE_KEYS = {"ts": "timestamp", "endpoint": "path", "status": "status_code", "duration_ms": "latency_ms", "event": "message"}


def parse_logs(lines: DataFrame, column: str = "value", open_fields: bool = False) -> DataFrame:
    """Log columns plus ``corrupt``, the line itself where it is no log record.

    Lines have the service's keys or the table's own.  A line without a time is no record.  ``open_fields`` adds
    ``fields``, the whole record as a variant, for keys that the table does not name: see ``open_field``.
    """
    corrupt = "corrupt"
    own = [StructField(f.name, DoubleType() if f.name == "duration_ms" else f.dataType) for f in LOG.fields]
    keys = [StructField(SERVICE_KEYS[f.name], f.dataType) for f in own if f.name in SERVICE_KEYS]
    schema = StructType([*own, *keys, StructField(corrupt, StringType())])
    parsed = F.from_json(
        F.col(column),
        schema,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt},
    )
    read = lines.select(F.col(column).alias("line"), parsed.alias("log"))

    def value(field):
        either = F.col(f"log.{field.name}")
        if field.name in SERVICE_KEYS:
            either = F.coalesce(either, F.col(f"log.{SERVICE_KEYS[field.name]}"))
        return either.cast(field.dataType).alias(field.name)

    more = [F.try_parse_json("line").alias("fields")] if open_fields else []
    rows = read.select(*map(value, LOG.fields), *more, "line", F.col("log.corrupt").alias("broken"))
    bad = F.col("broken").isNotNull() | F.col("ts").isNull()
    return rows.withColumn(corrupt, F.when(bad, F.col("line"))).drop("line", "broken")


def open_field(name: str, kind: str) -> Column:
    """A key of the record that has no column of its own; null where it is missing or of another kind."""
    return F.try_variant_get("fields", f"$.{name}", kind)


def split_logs(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log rows, corrupt lines)."""
    return (
        parsed.filter(F.col("corrupt").isNull()).drop("corrupt"),
        parsed.filter(F.col("corrupt").isNotNull()).select("corrupt"),
    )


def read_logs(spark: SparkSession, path: str, open_fields: bool = False) -> DataFrame:
    return parse_logs(spark.read.text(path), open_fields=open_fields)


def stream_logs(spark: SparkSession, path: str, open_fields: bool = False) -> DataFrame:
    return parse_logs(spark.readStream.text(path), open_fields=open_fields)
