"""Session defaults and the shared folder for written intermediates."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults a job may override.  Partition counts are left to adaptive execution,
# which coalesces small shuffles and splits skewed ones.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # recording the call site of every column costs seconds for wide plans
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "mailrisk", master: str | None = None, **options):
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that every executor can reach.

    The setting belongs to the cluster; only local sessions fall back to a
    temporary folder of the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="mailrisk-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


# State with timers and typed values needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> SparkSession:
    """Let streams that start from now on keep their state in the store that ``transformWithState`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def settled(rows: DataFrame, purpose: str) -> DataFrame:
    """Write a small intermediate result to the shared folder and go on from there.

    For aggregates that several branches of a plan read: branches that need
    different columns do not share a shuffle, so each would scan the input again.
    """
    path = shared_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
