"""Balanced label propagation over shards, in DataFrame functions only.

Equal texts are linked (each row to its group, so a group of n copies has n links, not n squared).  A group begins whole in
a shard by hash, as one part; one that is large for a shard as several, so that no part is.  In each round parts move: out
of shards above their capacity, into shards with room, in proportion to it; and towards the shard where most of their group
is, under quotas of the room there.  Rounds end when no shard is above its capacity and no link is cut, or when that stops
falling.  The groups that a shard still cannot hold and the rows without links then fill all shards in one line, group
beside group, to counts at most one apart, so the law `rows` holds exactly; slots follow from distributed ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, materialize

#: Rounds that bring no improvement after which the rest is left to the line.
PATIENCE = 2
#: Parts that a group as large as a shard is dealt in.
PARTS = 8
#: Rows that one ranking block holds on average, and blocks of one upper block.
BLOCK, UPPER = 4096, 1024


def describe(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(1), text).alias("g2"),
    )


def _ranked(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Gapless ranks from 0 within `by`, equal texts side by side.

    Rows are numbered inside small blocks; sums of the blocks before them come from two levels, so that no task sorts all
    blocks.  A group above BLOCK rows has blocks of its own.  Column `_total` says how many rows there are about.
    """
    pool = F.greatest(F.lit(1), F.floor(F.col("_total") / BLOCK)).cast("long")
    large = F.col("group_size") > BLOCK
    own = lambda x: F.when(large, x).otherwise(F.lit(0)).cast("long")
    at = F.pmod(F.when(F.col("group_size") > 1, F.col("g1")).otherwise(F.xxhash64("doc_id", "g1")), pool)
    block = F.struct(at.alias("at"), large.alias("large"), own(F.col("g1")).alias("g1"), own(F.col("g2")).alias("g2"), own(F.pmod(F.xxhash64("rid"), F.ceil(F.col("group_size") / BLOCK))).alias("salt"))
    rows = rows.withColumn("_block", block).withColumn("_upper", F.floor(at / UPPER)).drop("_total")
    counts = materialize(rows.groupBy(*by, "_upper", "_block").agg(F.count("*").alias("_n")))
    before = lambda *keys, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upper = counts.groupBy(*by, "_upper").agg(F.sum("_n").alias("_n"))
    upper = upper.select(*by, "_upper", before(*by, order="_upper").alias("_above"))
    lower = counts.select(*by, "_upper", "_block", before(*by, "_upper", order="_block").alias("_before"))
    starts = lower.join(upper, [*by, "_upper"]).select(*by, "_block", (F.col("_above") + F.col("_before")).alias("_start"))
    inner = Window.partitionBy(*by, "_block").orderBy("g1", "g2", "doc_id", "rid")
    numbered = rows.withColumn("_rank", F.row_number().over(inner) - 1)
    out = materialize(numbered.join(starts, [*by, "_block"]).withColumn(name, F.col("_start") + F.col("_rank")).drop("_block", "_upper", "_start", "_rank"))
    discard(counts)
    return out


def _unit(*keys) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _of(values: list, shard: str) -> Column:
    """The value of a shard."""
    return F.element_at(F.array(*map(F.lit, values)), F.col(shard) + 1)


def propagate(parts: DataFrame, target: list[int], rounds: int | None = None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """parts (g1, g2, part, alone, n, shard; a table) after rounds of moves, and for each round the rows above capacity and those cut off."""
    shards = range(len(target))
    history: list[tuple[int, int]] = []
    best, idle, state = None, 0, parts
    while True:
        load = {r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("n")).collect()}  # a row for each shard
        over, room = ([max(0, sign * (load.get(k, 0) - target[k])) for k in shards] for sign in (1, -1))
        tally = state.where("not alone").groupBy("g1", "g2", "shard").agg(F.sum("n").alias("n"))
        wish = materialize(tally.groupBy("g1", "g2").agg(F.max_by("shard", F.struct("n", -F.col("shard"))).alias("wish"), (F.sum("n") - F.max("n")).alias("cut")))
        cut = wish.agg(F.sum("cut")).first()[0] or 0
        history.append((sum(over), cut))
        if best is None or sum(over) + cut < best:
            best, idle, kept = sum(over) + cut, 0, state
        else:
            idle += 1
        if not best or idle == PATIENCE or (rounds is not None and len(history) > rounds):
            return kept, history
        step = len(history)
        both = state.join(wish.select("g1", "g2", "wish"), ["g1", "g2"], "left")
        asked = {r[0]: r[1] for r in both.where("wish <> shard").groupBy("wish").agg(F.sum("n")).collect()}  # a row for each shard
        leaves = _unit("g1", "g2", "part", F.lit(step)) < _of([over[k] / max(1, load.get(k, 0)) for k in shards], "shard")
        ends = [sum(room[: k + 1]) for k in shards]
        to = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= _unit("g2", "g1", "part", F.lit(step)) * F.lit(float(ends[-1]))))
        drawn = (F.col("wish") != F.col("shard")) & (F.col("n") <= _of(room, "wish")) & (_unit("part", "g1", F.lit(step)) < _of([min(1.0, room[k] / max(1, asked.get(k, 0))) for k in shards], "wish"))
        moved = F.when(leaves & F.lit(ends[-1] > 0), F.least(to, F.lit(len(target) - 1))).when(F.coalesce(drawn, F.lit(False)), F.col("wish")).otherwise(F.col("shard"))
        new = materialize(both.select("g1", "g2", "part", "alone", "n", moved.cast("int").alias("shard")))
        discard(wish)
        if state is not kept:
            discard(state)
        state = new


def assign(docs: DataFrame, shards: int = 40, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size for every row.

    Null texts count as empty and are linked with empty ones.  Repeated rows are rows of their own, dealt like others with
    their text; ties are broken by doc_id.  An empty table gives none, other columns are not looked at.  With rounds=None,
    rounds go on until nothing is cut or above its capacity, or PATIENCE of them bring no improvement.
    """
    base = materialize(describe(docs))
    total = base.count()
    sizes = materialize(base.groupBy("g1", "g2").agg(F.count("*").alias("group_size")).where("group_size > 1"))
    rows = materialize(base.join(sizes, ["g1", "g2"], "left").withColumn("group_size", F.coalesce("group_size", F.lit(1))).withColumn("rid", F.monotonically_increasing_id()))
    discard(base, sizes)
    target = [total // shards + (k < total % shards) for k in range(shards)]

    share = max(1, total // shards // PARTS)
    dealt = F.ceil(F.col("group_size") / share)
    linked = rows.where("group_size > 1").select("rid", "doc_id", "g1", "g2", "group_size", F.when(F.col("group_size") <= share, 0).otherwise(F.pmod(F.xxhash64("doc_id"), dealt)).cast("long").alias("part"))
    parts = linked.groupBy("g1", "g2", "part").agg(F.count("*").alias("n"), (F.max("group_size") <= share).alias("alone"))
    parts = materialize(parts.withColumn("shard", F.pmod(F.xxhash64("g1", "g2"), F.lit(shards)).cast("int")))
    state, _ = propagate(parts, target, rounds)

    placed = linked.join(state.select("g1", "g2", "part", "shard"), ["g1", "g2", "part"]).withColumn("_total", F.lit(total // shards))
    placed = _ranked(placed, ["shard"], "slot")
    inside = F.col("slot") < _of(target, "shard")
    # a group at the edge goes as a whole
    torn = materialize(placed.where(~inside & (F.col("group_size") <= min(share, BLOCK))).select("g1", "g2").distinct().withColumn("torn", F.lit(True)))
    placed = placed.join(torn, ["g1", "g2"], "left").withColumn("stays", inside & F.col("torn").isNull()).drop("torn")
    placed = materialize(placed)
    held = {r[0]: r[1] for r in placed.where("stays").groupBy("shard").count().collect()}  # a row for each shard
    room = [target[k] - held.get(k, 0) for k in range(shards)]
    ends = [sum(room[: k + 1]) for k in range(shards)]

    columns = ["rid", "doc_id", "g1", "g2", "group_size"]
    loose = rows.where("group_size = 1").select(*columns).unionByName(placed.where("not stays").select(*columns))
    loose = _ranked(loose.withColumn("_total", F.lit(ends[-1])).withColumn("one", F.lit(0)), ["one"], "rank")
    shard = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("rank")))
    loose = loose.withColumn("shard", shard.cast("int")).select("rid", "shard", (F.col("rank") - _of([ends[k] - room[k] for k in range(shards)], "shard") + _of([held.get(k, 0) for k in range(shards)], "shard")).alias("slot"))
    where = placed.where("stays").select("rid", "shard", "slot").unionByName(loose)
    return rows.join(where, "rid").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_size")


def cut_links(assigned: DataFrame) -> DataFrame:
    """One row of links, cut: rows with copies, and those outside the shard that most copies of their text are in.  Texts count as equal by size and CRC-32."""
    group = assigned.where("group_size > 1").groupBy("size", "text_crc32", "shard").agg(F.count("*").alias("n")).groupBy("size", "text_crc32").agg(F.sum("n").alias("links"), F.max("n").alias("most"))
    return group.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("links") - F.col("most")), F.lit(0)).alias("cut"))
