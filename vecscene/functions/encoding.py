"""Splats as vectors: 64 position, 512 colour and 64 attribute features.

What depends on the whole data set (position bounds, the colour range) is fitted once by an aggregate and kept in a small
model, so single splats and later queries can be encoded with the bounds of the index.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .vector import norm

#: Fixed values of the encoding.
TINY, RADIUS, SPREAD, RANGE_LIMIT = 1e-8, 2, 4.0, 1.5
POSITION_DIM, COLOR_BINS, ATTRIBUTE_DIM = 64, 8, 64


def position_bounds(df: DataFrame, position: str = "position") -> DataFrame:
    p = F.col(position)
    return df.agg(*[f(p[k]).alias(f"{name}{axis}") for k, axis in enumerate("xyz") for name, f in (("min_", F.min), ("max_", F.max))])


@dataclass(frozen=True)
class PositionModel:
    """Sines and cosines of the normalised axes at doubling frequencies; what dim leaves over is zero."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]
    dim: int = POSITION_DIM

    @staticmethod
    def fit(df: DataFrame, dim: int = POSITION_DIM, position: str = "position") -> PositionModel:
        r = position_bounds(df, position).first()
        axes = lambda name: tuple(float(r[f"{name}_{a}"] or 0.0) for a in "xyz")
        return PositionModel(axes("min"), axes("max"), dim)

    def _unit(self, position: Column) -> list[Column]:
        return [(position[k] - self.low[k]) / (self.high[k] - self.low[k] + TINY) for k in range(3)]

    def features(self, df: DataFrame, position: str = "position") -> DataFrame:
        """id, pos, x: the encoding as rows.  The waves are a list that is exploded, so the code made for a row is one short loop;
        with an expression for each number it is too long to be compiled."""
        n = max(1, self.dim // 6)
        waves = [(float(2**d), k, cos) for d in range(n) for k in range(3) for cos in (False, True)] + [(0.0, 0, None)] * max(0, self.dim - 6 * n)
        listed = F.array(*[F.struct(F.lit(a).alias("factor"), F.lit(k).alias("axis"), F.lit(cos).cast("boolean").alias("cos")) for a, k, cos in waves])
        rows = df.select("id", F.array(*self._unit(F.col(position))).alias("unit"), F.posexplode(listed).alias("pos", "wave"))
        phase = F.get("unit", F.col("wave.axis")) * F.col("wave.factor")
        return rows.select("id", "pos", F.when(F.col("wave.cos").isNull(), 0.0).when(F.col("wave.cos"), F.cos(phase)).otherwise(F.sin(phase)).alias("x"))

    def encode(self, position: Column) -> Column:
        n, unit = max(1, self.dim // 6), self._unit(position)
        waves = [f(u * float(2**d)) for d in range(n) for u in unit for f in (F.sin, F.cos)]
        return F.array(*waves, *[F.lit(0.0)] * max(0, self.dim - 6 * n))


@dataclass(frozen=True)
class ColorModel:
    """Histogram over bins ** 3 cells with weights exp(-d2 / 4) in the cube of two cells around the colour's own."""

    bytes_range: bool
    bins: int = COLOR_BINS

    @staticmethod
    def fit(df: DataFrame, bins: int = COLOR_BINS, color: str = "color") -> ColorModel:
        top = df.agg(F.max(F.array_max(color))).first()[0]
        return ColorModel(top is not None and top > RANGE_LIMIT, bins)

    def normalize(self, color: Column) -> Column:
        scale = 255.0 if self.bytes_range else 1.0
        return F.transform(color, lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / scale)))

    def cells(self, color: Column) -> Column:
        return F.transform(self.normalize(color), lambda c: F.least(F.floor(c * self.bins), F.lit(self.bins - 1)).cast("int"))

    def rows(self, color: Column) -> Column:
        """The bins ** 2 rows of the histogram along blue, in order; null where all of a row is zero.

        Weights are exp(-(dr2 + dg2 + db2) / 4), so a row depends on dr2 + dg2 and the blue cell alone and is looked up.
        """
        n, reach = self.bins, RADIUS * RADIUS
        weight = lambda d, e: math.exp(-(d * d + e) / SPREAD) if abs(d) <= RADIUS else 0.0
        table = F.array(*[F.array(*[F.lit(weight(i - c, e)) for i in range(n)]) for e in range(2 * reach + 1) for c in range(n)])
        # squared distances of an axis's cells from each cell; beyond the radius so far that no row is left
        far = 2 * reach + 1
        squares = F.array(*[F.array(*[F.lit((i - c) ** 2 if abs(i - c) <= RADIUS else far) for i in range(n)]) for c in range(n)])
        # a one-element array binds the cells, so that they are made once a colour
        axes = F.transform(F.array(self.cells(color)), lambda c: F.struct(F.get(squares, c[0]).alias("r"), F.get(squares, c[1]).alias("g"), c[2].alias("b")))
        plane = lambda a: F.flatten(F.transform(a["r"], lambda r: F.transform(a["g"], lambda g: F.get(table, (r + g) * n + a["b"]))))
        return F.transform(axes, plane)[0]

    def cell(self, color: Column) -> Column:
        """The colour's own cell as one number."""
        return F.transform(F.array(self.cells(color)), lambda c: (c[0] * self.bins + c[1]) * self.bins + c[2])[0]

    def whole(self, spark: SparkSession) -> DataFrame:
        """_cell, _histogram: the histogram of a colour in each cell, bins ** 3 of them."""
        n = self.bins
        squares = np.subtract.outer(np.arange(n), np.arange(n)) ** 2
        squares[squares > RADIUS * RADIUS] = 4 * RADIUS * RADIUS  # so far that the weight is zero
        weights = np.array([math.exp(-e / SPREAD) if e <= 3 * RADIUS * RADIUS else 0.0 for e in range(12 * RADIUS * RADIUS + 1)])
        r, g, b = squares[:, None, None, :, None, None], squares[None, :, None, None, :, None], squares[None, None, :, None, None, :]
        cells = weights[r + g + b].ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n**3 + 1) * n**3, pa.int32()), pa.array(cells))
        return spark.createDataFrame(pa.table({"_cell": pa.array(np.arange(n**3), pa.int32()), "_histogram": lists}))

    def histograms(self, spark: SparkSession) -> DataFrame:
        """cell, pos, x: what the histogram of a colour in each cell holds, without zeros."""
        return self.whole(spark).select(F.col("_cell").alias("cell"), F.posexplode("_histogram").alias("pos", "x")).where("x <> 0")

    def encode(self, color: Column) -> Column:
        zeros = F.array(*[F.lit(0.0)] * self.bins)
        return F.flatten(F.transform(self.rows(color), lambda row: F.coalesce(row, zeros)))


def attributes(opacity: Column, scale: Column, rotation: Column) -> Column:
    o, s, q = opacity, scale, rotation
    zero = F.lit(0.0)
    log = lambda x: F.when(x > 0, F.ln(x)).otherwise(F.when(x == 0, F.lit(-math.inf)).otherwise(F.lit(math.nan)))
    first = [o, o * o, o * o * o, F.sqrt(o + TINY), log(o + TINY), 1 - o, F.when(o > 0.5, 1.0).otherwise(0.0), F.when(o < 0.5, 1.0).otherwise(0.0)]
    sx, sy, sz = s[0], s[1], s[2]
    second = [sx, sy, sz, sx * sy * sz, (sx + sy + sz) / 3.0, norm(s), F.try_divide(sx, sy + TINY), F.try_divide(sx, sz + TINY), F.try_divide(sy, sz + TINY), sx * sx, sy * sy, sz * sz, *[log(x + TINY) for x in (sx, sy, sz)]]
    w, x, y, z = (q[i] for i in range(4))
    third = [w, x, y, z, w * w, x * x, y * y, z * z, w * x, w * y, w * z, x * y, x * z, y * z]
    return F.array(*first, *second, *[zero] * (32 - 8 - len(second)), *third, *[zero] * (ATTRIBUTE_DIM - 32 - len(third)))


@dataclass(frozen=True)
class EmbeddingModel:
    position: PositionModel
    color: ColorModel

    @staticmethod
    def fit(df: DataFrame) -> EmbeddingModel:
        return EmbeddingModel(PositionModel.fit(df), ColorModel.fit(df))

    @property
    def embedding_dim(self) -> int:
        return self.position.dim + self.color.bins**3 + ATTRIBUTE_DIM

    def transform(self, df: DataFrame) -> DataFrame:
        """df with a column embedding.  Histograms are met by cell: the cells' own, a table of bounded size, go out to the rows of df,
        which stay where they are."""
        rows = df.withColumn("_cell", self.color.cell(F.col("color"))).join(F.broadcast(self.color.whole(df.sparkSession)), "_cell", "left")
        embedding = F.concat(self.position.encode(F.col("position")), F.col("_histogram"), attributes(F.col("opacity"), F.col("scale"), F.col("rotation")))
        return rows.withColumn("embedding", embedding).drop("_cell", "_histogram")
