"""Tables in the shared folder that cut lineage, and vectors that narrow state can join without moving."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Only a local session without that setting (tests) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vecscene-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, *partition: str) -> DataFrame:
    """df as a table in the shared folder, read again: its plan is a scan."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition).parquet(path) if partition else df.write.parquet(path)
    # partition columns come last in what is read
    order = [c for c in df.columns if c not in partition] + list(partition)
    out = df.sparkSession.read.schema(df.select(*order).schema).parquet(path).select(*df.columns)
    out.table_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that `written` made, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "table_path", None) if df is not None else None:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


class Vectors:
    """Rows (key, row_id, v) dealt out and sorted by key, and kept: a table of narrow state by key meets them by a merge join
    that shuffles the state only.  key tells rows apart, also those of one row_id.  parts, if given, is the number of partitions."""

    def __init__(self, df: DataFrame, parts: int | None = None):
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keyed = df.select(F.monotonically_increasing_id().alias("key"), "row_id", "v")
        self.rows = keyed.repartition(parts, "key").sortWithinPartitions("key").persist()
        self.parts = parts

    def with_state(self, state: DataFrame) -> DataFrame:
        return self.rows.join(state.repartition(self.parts, "key").hint("merge"), "key")

    def release(self) -> None:
        self.rows.unpersist()
