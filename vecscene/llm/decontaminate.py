"""Benchmark decontamination by pigeonhole edit matching over words.

An item of m words may be found with e edited words.  Cut it into e + 1 pieces: at least one piece stands unedited in
any text that holds the item, so exact hits of piece beginnings give all candidates.  Each candidate window is verified by
Myers' bit-parallel edit distance, with words as symbols and Python integers as bit vectors of any length.

Words are runs of digits, ASCII letters (folded to lower case) and non-ASCII characters.  The items are a stated query set:
they go out in blocks of bounded size, each against all documents, so no join or shuffle of texts is needed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import PUNCT, Words, chunks, grams

#: Edited words allowed per word of an item, and words of a piece that are looked up (fewer where pieces are shorter).
RATE, PIECE = 0.15, 5
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 8 << 20
_TABLE = 20


def budget(m: int) -> int:
    """Words of an item of m words that may be edited."""
    return int(RATE * m)


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any stretch of the text, and where the first best stretch ends."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = defaultdict(int)
    for i, x in enumerate(pattern):
        peq[x] |= 1 << i
    up, down, score, best, at = full, 0, m, m, 0
    for j, x in enumerate(text):
        eq = peq.get(x, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(h | up)), up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(v | plus)), plus & v
        if score < best:
            best, at = score, j
    return best, at


class Items:
    """One block of items: hashed words, and a lookup from pieces to the items and places they come from."""

    def __init__(self, rows: list[tuple[int, str]]):
        w = Words(pa.array([t for _, t in rows], pa.string()), PUNCT, fold=True)
        self.ids = [i for i, _ in rows]
        self.words = [w.hash[a:b].tolist() for a, b in zip(w.ptr, w.ptr[1:])]
        found: dict[int, list] = defaultdict(list)
        for item, words in enumerate(self.words):
            m = len(words)
            if m:
                e = budget(m)
                n = min(PIECE, m // (e + 1))
                for at in sorted({j * m // (e + 1) for j in range(e + 1)}):
                    h = int(grams(np.array(words[at : at + n], np.uint64), n)[0])
                    found[n].append((h, item, at))
        self.pieces = {}
        for n, rows_ in found.items():
            rows_.sort()
            key = np.array([r[0] for r in rows_], np.uint64)
            table = np.zeros(1 << _TABLE, bool)
            table[key >> np.uint64(64 - _TABLE)] = True
            self.pieces[n] = (table, key, np.array([r[1] for r in rows_]), np.array([r[2] for r in rows_]))

    def hits(self, w: Words) -> Iterator[tuple[int, int, int, int]]:
        """Row, item, smallest distance and the word (from 0, in its row) where the first best stretch ends."""
        found = []
        for n, (table, key, item, at) in self.pieces.items():
            starts = w.starts_of(n)
            g = grams(w.hash, n)[starts]
            maybe = np.flatnonzero(table[g >> np.uint64(64 - _TABLE)])
            lo, hi = np.searchsorted(key, g[maybe]), np.searchsorted(key, g[maybe], side="right")
            count = hi - lo
            of = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            word = np.repeat(starts[maybe], count)
            found.append(np.stack([w.row_of(word), item[of], word - at[of]]))
        if not found:
            return
        row, item, begin = np.concatenate(found, 1)
        order = np.lexsort((begin, item, row))
        row, item, begin = row[order], item[order], begin[order]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))) if len(row) else row
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(row)]):
            r, i = int(row[a]), int(item[a])
            words = self.words[i]
            m, e = len(words), budget(len(self.words[i]))
            first, last = int(w.ptr[r]), int(w.ptr[r + 1])
            best, end = m + 1, 0
            lo = hi = None
            spans = []
            for s in begin[a:b].tolist():
                x, y = max(first, s - e), min(last, s + m + e)
                if lo is not None and x <= hi:
                    hi = max(hi, y)
                else:
                    if lo is not None:
                        spans.append((lo, hi))
                    lo, hi = x, y
            for lo, hi in [*spans, (lo, hi)]:
                d, at = myers(words, w.hash[lo:hi].tolist())
                if d < best:
                    best, end = d, lo + at - first
            if best <= e:
                yield r, i, best, end


def _match(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = list(items.hits(Words(part.column("text"), PUNCT, fold=True)))
                ids = part.column("doc_id")
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.take(pa.array([r[0] for r in rows], pa.int64())),
                        "item_id": pa.array([items.ids[r[1]] for r in rows], pa.int64()),
                        "n_edits": pa.array([r[2] for r in rows], pa.int64()),
                        "n_item_words": pa.array([len(items.words[r[1]]) for r in rows], pa.int64()),
                        "last_word": pa.array([r[3] for r in rows], pa.int64()),
                    }
                )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_edits, n_item_words, last_word: a row for each document (row) and item found in it.

    An item counts as found where an edit distance over words of at most budget(m) is met.  Null and empty texts hold
    nothing, null or wordless items are found nowhere, items of fewer than seven words only unedited.  Texts may have any
    length.  Repeated rows of documents give repeated rows, repeated items count once; of equally good stretches the first
    one's end is given.  An empty table on either side gives none; other columns are not looked at.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_edits long, n_item_words long, last_word long"
    docs = docs.select("doc_id", "text").where("text is not null")
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    out = None
    for k in range(n):
        rows = [(r[0], r[1]) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)).collect()]
        found = docs.mapInArrow(_match(spark.sparkContext.broadcast(rows)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents in which no item was found; rows with a null doc_id or text stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
