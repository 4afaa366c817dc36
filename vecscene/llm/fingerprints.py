"""Document fingerprints by Order MinHash: sketches whose likeness follows the edit distance of texts.

The elements of a text are its K-mers of code points, each numbered among its equals in order of the text, so a repeated
K-mer counts as often as it stands there.  Each of M permutations draws the L smallest elements; they are put back into
the order of the text, and the tuple of their K-mers is hashed.  Texts share a tuple only where they share the drawn
elements and their order, so moved passages count as changes, which a plain MinHash does not see.  A permutation is
low x odd number + high over the two halves of an element's 64-bit hash, modulo 2^32.

Equal texts have equal fingerprints; the likeness of two is the share of equal places.

The query needs the next document of each.  Rows are dealt out by ranges of doc_id and sorted inside them, so the next is
at hand but for the last row of a range; those few rows are written with the first ones of all ranges and meet by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import grams, materialize, mix

#: Code points of an element, elements of a tuple, and permutations.
K, L, M = 8, 2, 64
#: Cells of one block of permuted hashes.
CELLS = 1 << 16

_FACTORS = (mix(np.arange(1, 1025, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def elements(text: str, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the K-mers in order of the text, and of each with its number among equals; a shorter text is one K-mer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = grams(mix(points.astype(np.uint64) * _ONE), min(k, len(points)), seed=3)
    order = np.argsort(h, kind="stable")
    there = h[order]
    first = np.flatnonzero(np.append(True, there[1:] != there[:-1]))
    number = np.empty(len(h), np.uint64)
    number[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return h, mix(h + number * _TWO)


def sketch(text: str, k: int = K, ell: int = L, m: int = M) -> np.ndarray:
    """m tuple hashes of 32 bits; none for an empty text."""
    if not text:
        return np.zeros(0, np.uint32)
    h, numbered = elements(text, k)
    low, high = numbered.astype(np.uint32), (numbered >> np.uint64(32)).astype(np.uint32)
    n = min(ell, len(h))
    drawn = np.empty((m, n), np.int64)
    step = max(1, CELLS // len(h))
    for a in range(0, m, step):
        x = low * _FACTORS[a : min(a + step, m), None]
        x += high
        rows = np.arange(len(x))
        for i in range(n):
            at = x.argmin(1)  # the first among equals
            drawn[a : a + step, i] = at
            x[rows, at] = np.uint32(0xFFFFFFFF)
    drawn.sort(axis=1)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix(out * _ONE + h[drawn[:, i]])
    return (out >> np.uint64(32)).astype(np.uint32)


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal places; 1 for two empty texts, 0 for one."""
    return float((a == b).mean()) if len(a) and len(a) == len(b) else float(len(a) == len(b))


def likeness(a: Column, b: Column, m: int = M) -> Column:
    """alike for two columns of fingerprints as hexadecimal strings."""
    place = lambda c, i: F.substring(c, 1 + 8 * i, 8)
    same = sum(((place(a, i) == place(b, i)).cast("int") for i in range(m)), F.lit(0))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / m)


def _packed(x: np.ndarray) -> bytes:
    return x.astype(">u4").tobytes()


def fingerprints(docs: DataFrame, k: int = K, ell: int = L, m: int = M) -> DataFrame:
    """doc_id, n_chars, fingerprint (8 m hexadecimal digits; '' for null and empty texts) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "fingerprint": pa.array([_packed(sketch(t, k, ell, m)).hex() for t in texts], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


#: Kinds of rows: the first of a range, the last of it (both with their texts), and those that are done.
HEAD, LAST, DONE = range(3)
_ROW = "kind int, doc_id long, tid long, rid long, text string, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [x.split(" ")[0] for x in _ROW.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def edited(text: str, after: str) -> str:
    """The last third of the code points, rounded down, gives way to as many of the next text, or to all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def _done(key: tuple, text: str, own: np.ndarray, after: str, next_: np.ndarray) -> tuple:
    new = edited(text, after)
    changed = sketch(new)
    return (DONE, *key, None, len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), _packed(own), _packed(changed), alike(own, changed), alike(own, next_))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        out = []
        for *key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tid", "rid", "text"))):
            own = sketch(text)
            if held is None:
                out.append((HEAD, *key, text, *[None] * 6))
            else:
                out.append(_done(*held, text, own))
            held = (key, text, own)
        if out:
            yield _record(out)
    if held:
        yield _record([(LAST, *held[0], held[1], *[None] * 6)])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_done(tuple(key), text, sketch(text), after, sketch(after)) for *key, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tid", "rid", "text", "after")))]
        if rows:
            yield _record(rows)


def edit_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is that of the next smaller doc_id, and the largest after the smallest; null ids come last, and rows
    of one doc_id stand in the order of their texts' hashes, so repeated rows follow one another.  A null text is empty: its
    fingerprint is '', alike 1 to an empty text's and 0 to others.  A table of one row is its own next; an empty table gives
    none; texts may have any length; other columns are not looked at.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("tid"), F.monotonically_increasing_id().alias("rid"), "text")
    order = [F.col("doc_id").desc_nulls_last(), F.col("tid"), F.col("rid")]
    told = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chained, _ROW))
    # keys of two rows for each range, so one task sorts them
    ends = told.where(F.col("kind") < DONE).select("kind", "doc_id", "tid", "rid")
    window = Window.orderBy(*order, "kind")
    follows = ends.withColumn("next", F.coalesce(F.lead("rid").over(window), F.first("rid").over(window))).where(F.col("kind") == LAST).select("rid", "next")
    heads = told.where(F.col("kind") == HEAD).select(F.col("rid").alias("next"), F.col("text").alias("after"))
    last = told.where(F.col("kind") == LAST).select("doc_id", "tid", "rid", "text").join(follows, "rid").join(heads, "next")
    out = told.where(F.col("kind") == DONE).unionByName(last.select("doc_id", "tid", "rid", "text", "after").mapInArrow(_joined, _ROW))
    digits = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", "edited_sha256", digits("fingerprint"), digits("edited_fingerprint"), "near_edited", "near_next")
