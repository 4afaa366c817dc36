"""Samples without replacement: exactly n rows, the same for any partitioning, found by counting and taken by a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a draw, bits that one pass looks at, and numbers that are ordered on the driver.
BITS, STEP, FEW = 40, 10, 4096


def draw(seed: int, *salt: int, key: str = "row_id") -> Column:
    """A whole number below 2^BITS for each row, the same for any partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed), *map(F.lit, salt)), F.lit(1 << BITS))


def threshold(df: DataFrame, n: int, number: Column) -> tuple[int, int]:
    """(t, rest): the rows with number < t are fewer than n or n, and with `rest` rows of number t they are n.

    number is whole, from 0 to 2^BITS - 1.  Each pass counts the rows in the 2^STEP equal parts of the range that holds the
    n-th smallest, so what comes to the driver is 2^STEP counts, or FEW numbers, in BITS / STEP passes at most.
    """
    numbers = df.select(number.alias("h"))
    low, rest = 0, n
    for bits in range(BITS - STEP, -1, -STEP):
        part = numbers.where(F.col("h").between(low, low + (1 << (bits + STEP)) - 1)) if low or bits < BITS - STEP else numbers
        found = {r["b"]: r["count"] for r in part.groupBy(F.shiftright(F.col("h") - low, bits).alias("b")).count().collect()}
        for b in range(1 << STEP):
            here = found.get(b, 0)
            if rest <= here:
                low += b << bits
                break
            rest -= here
        else:
            return 1 << BITS, 0  # there are fewer than n rows
        if here == rest:  # the whole part belongs to the sample
            return low + (1 << bits), 0
        if here <= FEW and bits:
            left = sorted(r["h"] for r in numbers.where(F.col("h").between(low, low + (1 << bits) - 1)).collect())
            return left[rest - 1], rest - left.index(left[rest - 1])
    return low, rest


def sample(df: DataFrame, n: int, seed: int = 42, *salt: int, number: Column | None = None) -> DataFrame:
    """n rows of df drawn without replacement, or all where there are no more: the rows of smallest number (a hash of row_id
    and seed unless given), equal numbers by row_id.  Only numbers are counted; the rows are taken where they lie."""
    if n <= 0:
        return df.limit(0)
    number = draw(seed, *salt) if number is None else number
    t, rest = threshold(df, n, number)
    out = df.where(number < t)
    # rows of the very number t: one as a rule, and only those are ordered
    return out.unionByName(df.where(number == t).orderBy("row_id").limit(rest)) if rest else out
