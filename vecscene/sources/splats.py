"""Splat schema, JSON form, generated splats, and splats derived from the events table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.geometry import normalize_quaternion

_VECTOR = T.ArrayType(T.DoubleType())
SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("position", _VECTOR),
        T.StructField("color", _VECTOR),
        T.StructField("opacity", T.DoubleType()),
        T.StructField("scale", _VECTOR),
        T.StructField("rotation", _VECTOR),
        T.StructField("sh_coeffs", _VECTOR),
    ]
)
_DEFAULTS = {"position": [0.0] * 3, "color": [1.0] * 3, "opacity": 1.0, "scale": [1.0] * 3, "rotation": [1.0, 0.0, 0.0, 0.0], "sh_coeffs": None}


def conform(df: DataFrame) -> DataFrame:
    """A frame in SCHEMA: missing or null fields get their defaults, rotations are normalised."""
    out = []
    for f in SCHEMA.fields:
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        default = _DEFAULTS.get(f.name)
        if default is not None:
            value = F.coalesce(value, F.array(*map(F.lit, default)) if isinstance(default, list) else F.lit(default))
        out.append((normalize_quaternion(value) if f.name == "rotation" else value).alias(f.name))
    return df.select(*out)


def to_json(df: DataFrame) -> DataFrame:
    return df.select("id", F.to_json(F.struct(*[c for c in SCHEMA.names if c in df.columns])).alias("json"))


def from_json(df: DataFrame) -> DataFrame:
    return df.select(F.from_json("json", SCHEMA).alias("s")).select("s.*")


def _uniform(k: int, seed: int) -> Column:
    """A number in (0, 1) from the row's id: the same for any partitioning."""
    return (F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))


def _normal(k: int, seed: int) -> Column:
    return F.sqrt(-2 * F.ln(_uniform(2 * k, seed))) * F.cos(2 * math.pi * _uniform(2 * k + 1, seed))


def generate_for(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A splat for each id: normal rotations and positions (x 10), uniform colours and opacity, scales exp(-2 N(0, 1))."""
    normals = lambda first, size: F.array(*[_normal(first + i, seed) for i in range(size)])
    df = ids.select(
        "id",
        F.transform(normals(0, 3), lambda x: x * 10).alias("position"),
        F.array(*[_uniform(100 + i, seed) for i in range(3)]).alias("color"),
        _uniform(110, seed).alias("opacity"),
        F.transform(normals(10, 3), lambda x: F.exp(-2 * x)).alias("scale"),
        normals(20, 4).alias("rotation"),
    )
    return conform(df)


def generate(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n splats as generate_for makes them."""
    return generate_for(spark.range(n), seed)


#: Portable SQL: one splat for each event.
FROM_EVENTS = """
select event_id as id, user_id,
  value/10e0 as px, cast(user_id % 100 - 50 as double) as py, (event_id % 97)/10e0 as pz,
  ((event_id*37) % 256)/255e0 as r, ((user_id*53) % 256)/255e0 as g, ((event_id*11 + user_id*7) % 256)/255e0 as b,
  (event_id % 1001)/1000e0 as opacity,
  (1 + event_id % 7)/10e0 as sx, (1 + user_id % 5)/10e0 as sy, (1 + (event_id*3) % 11)/10e0 as sz,
  cast(1 + event_id % 3 as double) as qw, cast(user_id % 5 - 2 as double) as qx, cast(event_id % 11 - 5 as double) as qy, cast(user_id % 2 as double) as qz
from events"""


def flat_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value"), "event_id")
    return spark.sql(FROM_EVENTS.replace("from events", "from {events}"), events=events)


#: Rows that one task makes wide.
SPREAD = 1 << 16


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by hash of key before it is made wide: as many partitions as there are cores at least, and more as rows grow.
    A scan's own splits may leave all rows of a large row group to one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // SPREAD)), key)


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splats with raw (not normalised) rotations."""
    return flat_from_events(spark, sf_dir).select("id", "user_id", F.array("px", "py", "pz").alias("position"), F.array("r", "g", "b").alias("color"), "opacity", F.array("sx", "sy", "sz").alias("scale"), F.array("qw", "qx", "qy", "qz").alias("rotation"))
