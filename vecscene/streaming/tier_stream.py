"""The tier replay as a streaming query: one keyed state for each cache, accesses in order of seq inside a micro-batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tiering import OUTCOME, TierState, outcomes


def _dump(s: TierState) -> str:
    return json.dumps([list(s.vram), list(s.ram), sorted(s.cold), sorted(s.count.items()), s.hits, s.misses, s.evictions])


def _load(s: TierState, text: str) -> None:
    vram, ram, cold, count, s.hits, s.misses, s.evictions = json.loads(text)
    s.vram.update(dict.fromkeys(vram))
    s.ram.update(dict.fromkeys(ram))
    s.cold, s.count = set(cold), dict(count)


def replay_stream(log: DataFrame, vram_limit: int, ram_limit: int, threshold: float = 1.0, promote_after: int = 10) -> DataFrame:
    """OUTCOME rows of a streaming access log (cache, seq, splat_id); an id is added cold when first seen."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tiers = TierState(vram_limit, ram_limit, threshold, promote_after)
        if state.exists:
            _load(tiers, state.get[0])
        # of a micro-batch only two numbers an access are held; rows are made and passed on in chunks
        parts = [pdf[["seq", "splat_id"]].to_numpy(np.int64) for pdf in frames]
        held = np.concatenate(parts)
        parts.clear()
        held = held[np.argsort(held[:, 0], kind="stable")]
        yield from outcomes(tiers, int(key[0]), held[:, 0], held[:, 1])
        state.update((_dump(tiers),))

    return log.select("cache", "seq", "splat_id").groupBy("cache").applyInPandasWithState(step, OUTCOME, "tiers string", "append", GroupStateTimeout.NoTimeout)
