"""Shared helpers: tables that cut lineage, table reading, and vectorised word hashing used inside tasks."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once inside a Python task; bounds its memory whatever the batch size.
CHUNK_BYTES = 4 << 20

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Spark's setting that deletes a query's shuffle files once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Only a local session without that setting (tests) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vecscene-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written in the shared folder, and read again; the shuffle files that it took go at once.

    A checkpoint would run the last stage twice, once to count its rows and once to write them.
    """
    spark = df.sparkSession
    path, was = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    if _OWNERS:
        _OWNERS[-1].append(out)
    return out


#: Lists of the tables made inside each `owned` that is open, innermost last.
_OWNERS: list[list[DataFrame]] = []


@contextlib.contextmanager
def owned(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Tables that materialize writes inside are deleted at the end, but for those in the list that is given, which the caller
    may add to."""
    keep, made = list(kept), []
    _OWNERS.append(made)
    try:
        yield keep
    finally:
        _OWNERS.remove(made)
        staying = {getattr(df, "table_path", None) for df in keep}
        discard(*(df for df in made if df.table_path not in staying))


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that materialize wrote, once all that reads them has been written itself."""
    for df in tables:
        if path := getattr(df, "table_path", None) if df is not None else None:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bijection on uint64."""
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Bytes that separate words: space and U+0009 to U+000D.
BLANK = _lut(bytes([0x20, *range(0x09, 0x0E)]))
#: Bytes that separate alphanumeric words: ASCII other than digits and letters.
PUNCT = _lut(bytes(x for x in range(128) if not chr(x).isalnum()))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (nulls count as empty) and each row's offsets into them."""
    column = column.fill_null("").cast(pa.large_string())
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and len(column) else np.zeros(0, np.uint8)
    return data, off - off[0] if len(off) else np.zeros(1, np.int64)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; of two different spans of up to eight bytes and one length never the same."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    size = end - start
    h = size.astype(np.uint64) * _C1
    live = np.arange(len(size))
    done = 0
    while len(live):
        left = size[live] - done
        load = eight[start[live] + done]
        mask = (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[live] = mix(h[live] ^ np.where(left < 8, load & mask, load))
        done += 8
        live = live[left > 8]
    return h


class Words:
    """Words of a chunk of texts: byte spans, 64-bit hashes, and each row's range of words."""

    def __init__(self, column: pa.Array, separators: np.ndarray = BLANK, fold: bool = False):
        self.data, self.off = text_buffer(column)
        n = len(self.data)
        sep = np.ones(n + 1, bool)
        sep[:n] = separators[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        before = np.empty(n + 1, bool)
        before[0] = True
        before[1:] = sep[:-1]
        inside = ~sep
        self.start = np.flatnonzero(inside & (before | edge))
        after = np.zeros(n + 1, bool)
        after[1:] = inside[:-1]
        self.end = np.flatnonzero(after & (sep | edge))
        self.ptr = np.searchsorted(self.start, self.off)
        self.hash = span_hash(_FOLD[self.data] if fold else self.data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.off) - 1

    def row_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ptr, word, side="right") - 1

    def starts_of(self, k: int) -> np.ndarray:
        """Indices of words that begin k consecutive words of one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        last = np.repeat(self.ptr[1:], np.diff(self.ptr))  # the end of the row that holds each word
        i = np.arange(n)
        return i[i + k <= last[:n]]


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive values; runs that cross rows are for the caller to skip."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = mix(np.arange(1 + seed * 1000, k + 1 + seed * 1000, dtype=np.uint64) * _C1) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * factor[j]
    return mix(out)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `limit` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    size = np.diff(text_buffer(col)[1])
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
