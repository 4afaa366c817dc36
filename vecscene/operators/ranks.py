"""Places and percentiles over groups of any size, without one task or one buffer that holds a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..tables import written

#: Candidates for a value that one pass counts against, and values that are ordered on the driver.
EDGES, FEW = 64, 4096


def places(df: DataFrame, group: str, order: str, name: str = "place") -> DataFrame:
    """group, order and the place of each row in its group, from 0, by order (unique in a group).

    Rows are dealt out by ranges of (group, order), so a large group lies in several tasks of even size.  The first row of a group in
    each task and their number there are one row for each pair that occurs, ranges and groups at most; running sums over those
    give where each task's part of a group begins.  The result reads a table that discard(result) deletes.
    """
    rows = df.select(group, order).repartitionByRange(group, order).sortWithinPartitions(group, order)
    # the place of a row in all: its task in the high bits, its place there in the low ones
    numbered = written(rows.withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    parts = numbered.groupBy(group, task.alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col(group).alias("_group"), F.col("task").alias("_task"), (before - F.col("first")).alias("shift"))
    out = numbered.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (task == F.col("_task")))
    out = out.select(group, order, (F.col("at") + F.col("shift")).alias(name))
    out.table_path = numbered.table_path
    return out


def _between(value: Column, low, high) -> Column:
    """low < value < high; None is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (value > low)
    return out & (value < high) if high is not None else out


def _nth(df: DataFrame, ranks: list[int]) -> tuple[dict[int, float], int]:
    """Values (column x, no nulls) at ranks from 0, and the passes that took.

    Each rank lies between two values, at first anywhere.  A pass takes some values of what lies between them as edges, from a
    sketch of bounded size, and counts the rows below and up to each; that names the edge that is the value, or two nearer ones.
    The sketch only proposes: counts are exact.  Where few rows are left, they are counted value by value.
    """
    found: dict[int, float] = {}
    open_ = {(None, None): (0, df, sorted(set(ranks)))}  # bounds to rows below them, the rows and their ranks
    passes = 0
    while open_:
        nearer: dict = {}
        for (low, high), (below, rows, wanted) in open_.items():
            passes += 1
            n, edges = rows.agg(F.count("*"), F.percentile_approx("x", [i / (EDGES - 1) for i in range(EDGES)], 10_000)).first()
            if n <= FEW:
                at = below
                for value, count in sorted((r["x"], r["count"]) for r in rows.groupBy("x").count().collect()):  # FEW at most
                    found |= {r: value for r in wanted if at <= r < at + count}
                    at += count
                continue
            edges = sorted(set(edges))
            x = F.col("x")
            counts = rows.agg(*[F.sum((x < e).cast("long")) for e in edges], *[F.sum((x <= e).cast("long")) for e in edges]).first()
            less, upto = [below + c for c in counts[: len(edges)]], [below + c for c in counts[len(edges) :]]
            for r in wanted:
                i = next((i for i in range(len(edges)) if r < upto[i]), len(edges))
                if i < len(edges) and less[i] <= r:
                    found[r] = edges[i]
                    continue
                bounds = (edges[i - 1] if i else low, edges[i] if i < len(edges) else high)
                nearer.setdefault(bounds, (upto[i - 1] if i else below, rows.where(_between(x, *bounds)), []))[2].append(r)
        open_ = nearer
    return found, passes


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles, linear between ranks, of the values that are not null; None for each where there are none."""
    rows = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n = rows.count()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    found, _ = _nth(rows, [f(a) for a in at for f in (math.floor, math.ceil)])
    pairs = [(found[math.floor(a)], found[math.ceil(a)], a - math.floor(a)) for a in at]
    return [low if low == high else low + (high - low) * part for low, high, part in pairs]
