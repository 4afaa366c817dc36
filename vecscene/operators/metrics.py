"""Latency figures and results of benchmark runs, and their JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranks import percentiles


def latency_summary(df: DataFrame, column: str) -> DataFrame:
    """n, mean, population deviation, exact p50 and p95 (linear between ranks), max, and queries per second for latencies in seconds.

    Percentiles are found by counting, at once; no buffer holds the values.
    """
    c = F.col(column)
    p50, p95 = (F.lit(x).cast("double") for x in percentiles(df, column, [0.5, 0.95]))
    return df.agg(
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("std"),
        p50.alias("p50"),
        p95.alias("p95"),
        F.max(c).alias("max"),
        F.try_divide(F.count(c), F.sum(c)).alias("qps"),
    )


def cluster_sizes(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.groupBy(label).agg(F.count("*").alias("size"))


def write_json(df: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    df.write.mode("overwrite").json(path)
