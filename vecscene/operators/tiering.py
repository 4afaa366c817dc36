"""A replayed three-tier least-recently-used cache: cold, then RAM, then VRAM after enough accesses.

One cache is one ordered log, so `cache` is the key the work is dealt by: logs of many caches replay side by side.  State
per cache is bounded by its tier limits and known ids.  Without evictions the outcome of an access depends only on its number
among the accesses of its id, which the window form uses.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


class TierState:
    """Transitions of one cache.  Ids begin cold, or in RAM if the add says so."""

    def __init__(self, vram_limit: int, ram_limit: int, threshold: float = 1.0, promote_after: int = 10):
        self.vram_limit, self.ram_limit, self.threshold, self.promote_after = vram_limit, ram_limit, threshold, promote_after
        self.vram: OrderedDict[int, None] = OrderedDict()
        self.ram: OrderedDict[int, None] = OrderedDict()
        self.cold: set[int] = set()
        self.count: dict[int, int] = {}
        self.hits = self.misses = self.evictions = 0

    def add(self, key: int, to_cold: bool = True) -> None:
        if to_cold:
            self.cold.add(key)
        else:
            self.ram[key] = None
        self.count[key] = 0

    def access(self, key: int) -> tuple[str, bool, int | None]:
        """Where the id was found (vram, ram, cold, missing), whether it moved up to VRAM, and an id that was pushed down."""
        self.count[key] = n = self.count.get(key, 0) + 1
        if key in self.vram:
            self.vram.move_to_end(key)
            self.hits += 1
            return "vram", False, None
        if key in self.ram:
            self.ram.move_to_end(key)
            self.hits += 1
            if n < self.promote_after:
                return "ram", False, None
            gone = None
            if len(self.vram) >= self.vram_limit * self.threshold and self.vram:
                gone, _ = self.vram.popitem(last=False)
                self.ram[gone] = None
                self.evictions += 1
            del self.ram[key]
            self.vram[key] = None
            return "ram", True, gone
        self.misses += 1
        if key not in self.cold:
            return "missing", False, None
        gone = None
        if len(self.ram) >= self.ram_limit * self.threshold and self.ram:
            gone, _ = self.ram.popitem(last=False)
            self.evictions += 1
        self.ram[key] = None
        return "cold", False, gone


OUTCOME = "cache long, seq long, splat_id long, outcome string, promoted boolean, evicted_id long"
#: Accesses that a task turns into rows at once.
CHUNK = 1 << 14


def outcomes(state: TierState, cache: int, seq: np.ndarray, splat: np.ndarray) -> Iterator[pd.DataFrame]:
    """OUTCOME rows of accesses in order, CHUNK of them at a time; an id is added cold when first seen."""
    for a in range(0, len(seq), CHUNK):
        ids, told = splat[a : a + CHUNK].tolist(), []
        for key in ids:
            if key not in state.count:
                state.add(key)
            told.append(state.access(key))
        where, moved, gone = zip(*told)
        yield pd.DataFrame({"cache": cache, "seq": seq[a : a + CHUNK], "splat_id": ids, "outcome": where, "promoted": moved, "evicted_id": pd.array(gone, "Int64")})


def replay(log: DataFrame, vram_limit: int, ram_limit: int, threshold: float = 1.0, promote_after: int = 10) -> DataFrame:
    """OUTCOME rows of an access log (cache, seq, splat_id) in order of seq; all its ids were added cold before.

    Spark deals out and sorts the accesses; a task reads them as a stream and holds the state of one cache."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, held = None, None
        for pdf in frames:
            caches = pdf["cache"].to_numpy()
            cut = np.flatnonzero(np.append(True, caches[1:] != caches[:-1])) if len(caches) else []
            for a, z in zip(cut, [*cut[1:], len(caches)]):
                if state is None or caches[a] != held:
                    state, held = TierState(vram_limit, ram_limit, threshold, promote_after), caches[a]
                yield from outcomes(state, int(held), pdf["seq"].to_numpy()[a:z], pdf["splat_id"].to_numpy()[a:z])

    rows = log.select("cache", "seq", "splat_id").repartition("cache").sortWithinPartitions("cache", "seq")
    return rows.mapInPandas(run, OUTCOME)


def access_counts(log: DataFrame) -> DataFrame:
    """cache, seq, splat_id, n: the number of each access among those of its id, by ts (where the log has it) and seq."""
    order = ["ts", "seq"] if "ts" in log.columns else ["seq"]
    return log.withColumn("n", F.row_number().over(Window.partitionBy("cache", "splat_id").orderBy(*order))).select("cache", "seq", "splat_id", "n")


def outcomes_without_evictions(log: DataFrame, promote_after: int = 10) -> DataFrame:
    """The replay's outcomes where no limit is reached: cold, RAM up to the promotion, then VRAM."""
    top = max(2, promote_after)
    n = F.col("n")
    return access_counts(log).select("cache", "seq", "splat_id", F.when(n == 1, "cold").when(n <= top, "ram").otherwise("vram").alias("outcome"), (n == top).alias("promoted"))


def totals(outcomes: DataFrame) -> DataFrame:
    """hits, misses and promotions of each cache."""
    return outcomes.groupBy("cache").agg(F.count_if(F.col("outcome").isin("vram", "ram")).alias("cache_hits"), F.count_if(F.col("outcome").isin("cold", "missing")).alias("cache_misses"), F.count_if("promoted").alias("promotions"))


def final_tiers(log: DataFrame, promote_after: int = 10) -> DataFrame:
    """Where each id ends up where no limit is reached."""
    return log.groupBy("cache", "splat_id").agg(F.count("*").alias("accesses")).select("cache", "splat_id", F.when(F.col("accesses") >= max(2, promote_after), "vram").otherwise("ram").alias("tier"))
