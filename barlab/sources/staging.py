"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a stage is written, the shuffle files of its query go when it ends, and rows go to Python in small batches.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or, where that is unset,
    /tmp/checkpoints under a local master and the warehouse otherwise."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return "file:///tmp/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table below the shared folder and read it back: lineage ends there, and every executor can read
    it after another one is lost. The shuffle files behind the table go once it is written."""
    spark, schema = df.sparkSession, df.schema
    path = f"{checkpoint_root(spark)}/barlab/{label}-{uuid.uuid4().hex}"
    with _writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again: those whose successor is written. A session without a JVM of its own
    leaves them where they are."""
    for table in tables:
        path, session = getattr(table, "staged_at", None), table.sparkSession
        if path and hasattr(session, "_jvm"):
            file = session._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(file, True)


#: Seconds of a slot of a stored tape, which is a UTC day.
SLOT_SECONDS = 86_400


def stored_tape(trades: DataFrame, label: str = "tape") -> DataFrame:
    """Trades written once for many joins: partitioned by UTC day, for scans of a range of time, and in it bucketed by symbol
    and slot and sorted by time, so that joins on these move only their other side. Adds day (text) and slot (the day's
    number). A day of a symbol lies in one file."""
    spark = trades.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"barlab_{label}_{uuid.uuid4().hex}"
    slot = F.floor(F.unix_seconds("ts") / SLOT_SECONDS)
    rows = trades.withColumns({"slot": slot, "day": F.date_format("ts", "yyyy-MM-dd")}).repartition(n, "symbol", "slot")
    with _writing(spark):
        rows.write.format("parquet").option("compression", "zstd").option("path", f"{checkpoint_root(spark)}/barlab/{name}").partitionBy("day").bucketBy(
            n, "symbol", "slot"
        ).sortBy("symbol", "slot", "ts", "trade_id").saveAsTable(name)
    out = spark.table(name)
    out.tape_name = name
    return out
