"""What the operators of this subpackage share: the scratch folder and a few columns."""

import tempfile
import uuid

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Words are runs of anything but blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a session that runs in one process and has no such setting gets a temporary
    folder of the machine; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="mailrisk-llm-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settled(rows: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the files.

    Lineage ends there and lost executors lose nothing.
    """
    path = scratch(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def matched(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """Inner join on columns of the same names, where null equals null."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in columns})
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(renamed, condition).drop(*[f"_right_{c}" for c in columns])


def small(batches, rows: int = 512):
    """The rows of Arrow batches in smaller ones, so that a task's copies of texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_bytes(batches, texts, most: int = 4 << 20, rows: int = 512):
    """Slices of Arrow batches of at most ``rows`` rows and about ``most`` bytes of text, or of one longer text.

    ``texts`` gives a batch's text column.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(texts(batch)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            end = int(size.searchsorted(before + most, side="right"))
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def with_fields(rows: DataFrame, *fields: tuple[str, str]) -> StructType:
    """The schema of ``rows`` and further ``(name, type)`` fields."""
    out = StructType(list(rows.schema.fields))
    for name, kind in fields:
        out = out.add(name, kind)
    return out
