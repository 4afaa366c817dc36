"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-tokens are found without a regex.  Each code point becomes one of ten symbols (its class, with a bounded look
ahead folded in).  A symbol is a transition function on eight states; composing functions is associative, and the
functions reachable by composition form a small closed set, so a table composes them.  A blocked scan over whole
chunks of texts gives the state before each code point, and the state with the symbol tells where a token starts.

The slices then go through a cache of merged pieces.  Offsets of slices and of vocabulary bytes are kept, so decoding
is a gather.  Memory of a task: one chunk of texts and a cache of a fixed number of slices.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from .common import chunks, span_hash, text_buffer

#: Slices kept in a worker's cache before it starts afresh.
CACHE_SLICES = 300_000
#: Longest slice merged side by side with others, in bytes; and a rank beyond all ranks.
_WIDE = 32
_FAR = 1 << 30

# Symbols: letter, number, other, contraction of 2 and of 3 code points, inner blank, space before a token, lone blank, end of a text.
L, N, O, A2, A3, W, E, X, END = range(9)
# States: the token so far is letters, numbers, others, blanks, one space that joins what follows; nothing; one or two code points left of a contraction.
S_L, S_N, S_O, S_W, S_E, S_NEW, S_C1, S_C2 = range(8)


def _step(state: int, symbol: int) -> int:
    if symbol == END:
        return S_NEW
    if state == S_C2:
        return S_C1
    if state == S_C1:
        return S_NEW
    if symbol in (A2, A3):
        if state in (S_O, S_E):
            return S_O
        return S_C1 if symbol == A2 else S_C2
    return {L: S_L, N: S_N, O: S_O, W: S_W, E: S_E, X: S_NEW}[symbol]


def _begins(state: int, symbol: int) -> bool:
    if symbol == END:
        return True
    joins = {L: (S_L, S_E, S_C1, S_C2), N: (S_N, S_E), O: (S_O, S_E), A2: (S_O, S_E), A3: (S_O, S_E), W: (S_W,), E: (), X: ()}
    return state not in joins[symbol]


@functools.cache
def _monoid():
    """Closed set of transition functions: ids of the symbols, composition table, state after starting anew, starts."""
    base = [tuple(_step(s, x) for s in range(8)) for x in range(9)]
    identity = tuple(range(8))
    known = {identity: 0}
    todo = [identity]
    while todo:
        f = todo.pop()
        for g in base:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    funcs = list(known)
    table = np.array([[known[tuple(g[s] for s in f)] for g in funcs] for f in funcs], np.uint16)
    symbol_id = np.array([known[g] for g in base], np.uint16)
    apply = np.array(funcs, np.uint8)
    begins = np.array([[_begins(s, x) for x in range(9)] for s in range(8)])
    return symbol_id, table, apply, begins


@functools.cache
def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 blank, for each code point."""
    out = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    shift = lambda i: i if i < 0xD800 else i + 0x800
    for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, points):
            out[shift(m.start()) : shift(m.end() - 1) + 1] = value
    return out


def _prefix(ids: np.ndarray, table: np.ndarray, width: int = 256) -> np.ndarray:
    """Exclusive scan: the composition of all functions before each position."""
    n = len(ids)
    if n <= width:
        out = np.zeros(n, np.uint16)
        f = 0
        for i, g in enumerate(ids.tolist()):
            out[i] = f
            f = table[f, g]
        return out
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)  # 0 is the identity
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    local = np.empty_like(grid)
    f = np.zeros(rows, np.uint16)
    for j in range(width):
        local[j] = f
        f = table[f, grid[j]]
    before = _prefix(f, table, width)
    return table[before[None, :], local].T.reshape(-1)[:n]


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """points holds, after each text, one position that only marks its end (ends)."""
    kind = _classes()[points]
    n = len(points)
    out = np.array([O, L, N, W], np.uint8)[kind]
    out[ends] = END
    nxt = np.full(n + 2, 0, np.uint32)
    nxt[:n] = points
    nxt[:n][ends] = 0
    is_end = np.zeros(n + 1, bool)
    is_end[ends] = True
    blank = np.zeros(n + 1, bool)
    blank[:n] = kind == 3
    blank[:n][ends] = False
    lone = np.flatnonzero(blank[:n] & ~blank[1:] & ~is_end[1:])
    out[lone] = np.where(points[lone] == 32, E, X)
    quote = np.flatnonzero(nxt[:n] == 39)
    if len(quote):
        a, b = nxt[quote + 1], nxt[quote + 2]
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[quote[two]] = A2
        out[quote[three]] = A3
    return out


def pretokens(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, byte offsets where tokens start (one past the last included), each row's range of tokens."""
    data, off = text_buffer(column)
    raw = data.tobytes()
    lead = (data & 0xC0) != 0x80
    char_at = np.flatnonzero(lead)
    text = raw.decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    char_off = np.searchsorted(char_at, off)
    ends = char_off[1:] + np.arange(len(off) - 1)
    full = np.insert(points, char_off[1:], 0)
    sym = _symbols(full, ends)
    symbol_id, table, apply, begins = _monoid()
    state = apply[_prefix(symbol_id[sym], table), S_NEW]
    start = begins[state, sym]
    start[ends] = False
    at = np.flatnonzero(start)
    at -= np.searchsorted(ends, at)  # without the end marks before it
    cut = np.append(char_at[at], len(raw))
    return raw, cut, np.searchsorted(cut[:-1], off)


class Vocabulary:
    """Ranks of a byte-level BPE file, the merge of one slice, and its bytes for decoding."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        top = max(self.ranks.values()) + 1
        pieces = [b""] * top
        for k, v in self.ranks.items():
            pieces[v] = k
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([len(x) for x in pieces], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        return self._merge_long(piece)

    @functools.cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys (left id, right id) of all pairs that some token joins, sorted, and the tokens."""
        found = [((a << 32) | b, v) for k, v in self.ranks.items() for i in range(1, len(k)) if (a := self.ranks.get(k[:i])) is not None and (b := self.ranks.get(k[i:])) is not None]
        keys, tokens = np.array(sorted(found), np.int64).reshape(-1, 2).T
        return np.ascontiguousarray(keys), tokens.astype(np.int32)

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, tokens = self._pairs
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[i] == key) & (right >= 0), tokens[i], _FAR)

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Merges of short slices side by side: in each round every slice joins its lowest pair, leftmost among equals."""
        size = np.array([len(x) for x in pieces])
        out: list = [None] * len(pieces)
        single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        for low, width in ((0, 8), (8, 12), (12, 20), (20, _WIDE)):
            rows = np.flatnonzero((size > low) & (size <= width))
            if not len(rows):
                continue
            raw = np.frombuffer(b"".join(pieces[i].ljust(width + 1, b"\0") for i in rows), np.uint8).reshape(len(rows), width + 1)
            col = np.arange(width + 1, dtype=np.int64)
            ids = np.where(col < size[rows][:, None], single[raw], -1).astype(np.int32)
            whole = ids  # finished rows stay here
            live = np.arange(len(rows))
            rank = self._join(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width)
            while True:
                at = rank.argmin(1)
                best = rank[np.arange(len(at)), at]
                go = best < _FAR
                if not go.all():
                    whole[live[~go]] = ids[~go]
                    live, ids, rank, at, best = live[go], ids[go], rank[go], at[go], best[go]
                if not len(live):
                    break
                n = np.arange(len(live))
                step = np.minimum(col + (col > at[:, None]), width)
                ids = np.take_along_axis(ids, step, 1)
                ids[:, -1] = -1
                ids[n, at] = best
                step = np.minimum(col[:-1] + (col[:-1] >= at[:, None]), width - 1)
                rank = np.take_along_axis(rank, step, 1)
                rank[:, -1] = _FAR
                rank[n, at] = self._join(ids[n, at], ids[n, at + 1])
                left = np.flatnonzero(at > 0)
                rank[left, at[left] - 1] = self._join(ids[left, at[left] - 1], ids[left, at[left]])
            count = (whole >= 0).sum(1)
            flat = whole[whole >= 0].tolist()
            end = np.cumsum(count).tolist()
            for i, a, b in zip(rows.tolist(), [0, *end], end):
                out[i] = tuple(flat[a:b])
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost among equals, by a heap over a linked list: for slices of any length."""
        n = len(piece)
        end = list(range(1, n + 1))
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        get = self.ranks.get
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] - i != size:
                continue
            alive[j] = False
            end[i] = end[j]
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for a in (prev[i], i):
                if a >= 0 and nxt[a] < n:
                    b = end[nxt[a]]
                    if (r := get(piece[a:b])) is not None:
                        heapq.heappush(heap, (r, a, b - a))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = nxt[i]
        return tuple(out)

    def ids(self, slices: list[bytes]) -> list[tuple[int, ...]]:
        cache = self.cache
        if len(cache) > CACHE_SLICES:
            cache.clear()
        out = list(map(cache.get, slices))
        missing = [x for x, found in zip(slices, out) if found is None]
        if missing:
            short = [x for x in missing if len(x) <= _WIDE]
            # side by side only pays for many
            found = dict(zip(short, self.merge_many(short) if len(short) >= 64 else map(self.merge, short)))
            cache.update(found)
            found |= {x: self.merge(x) for x in missing if len(x) > _WIDE}
            out = [found[s] if x is None else x for s, x in zip(slices, out)]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        begin = np.cumsum(size) - size
        return self.bytes[np.arange(int(size.sum())) + np.repeat(self.at[ids] - begin, size)].tobytes()


@functools.lru_cache(maxsize=2)
def _vocabulary(name: str) -> Vocabulary:
    with open(SparkFiles.get(name), "rb") as f:
        return Vocabulary(f.read())


def ship(df: DataFrame, path: str) -> str:
    """Give the vocabulary file at a path to all executors; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


@functools.cache
def _decimals() -> np.ndarray:
    """Bytes of the decimal numbers below 100,000, five places, right-aligned, and in the sixth the comma."""
    n = np.arange(100_000, dtype=np.int64)
    out = np.empty((100_000, 6), np.uint8)
    for j in range(5):
        out[:, j] = 48 + n // 10 ** (4 - j) % 10
    out[:, 5] = 44
    return out


def _joined(ids: np.ndarray) -> bytes:
    """Decimal ids joined by commas."""
    if not len(ids):
        return b""
    if ids.max() >= 100_000:
        return b",".join(b"%d" % i for i in ids.tolist())
    digits = 1 + (ids >= 10) + (ids >= 100) + (ids >= 1000) + (ids >= 10000)
    grid = _decimals()[ids]
    return grid[np.arange(6)[None, :] >= (5 - digits)[:, None]].tobytes()[:-1]


def encode_rows(part: pa.RecordBatch, vocab: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row its ids and the byte offsets in the text where its pre-tokens start.

    Slices are looked up once a chunk, by hash; the decoded bytes are held against the text, and should two
    slices ever share a hash, the chunk is done again slice by slice.
    """
    raw, cut, ptr = pretokens(part.column("text"))
    start, end = cut[:-1], cut[1:]
    _, one, which = np.unique(span_hash(np.frombuffer(raw, np.uint8), start, end), return_index=True, return_inverse=True)
    for first, of in ((one, which), (np.arange(len(start)), np.arange(len(start)))):
        found = vocab.ids([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(size.sum()))
        n = size[of]
        stop = np.cumsum(n)
        ids = flat[np.arange(int(n.sum())) + np.repeat((np.cumsum(size) - size)[of] - (stop - n), n)]
        if vocab.decode(ids) == raw:
            break
    edge = np.append(0, stop)
    for a, b in zip(ptr, ptr[1:]):
        yield ids[edge[a] : edge[b]], cut[a:b]


def _digests(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(name)
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = [(len(ids), hashlib.sha256(_joined(ids)).hexdigest(), hashlib.sha256(vocab.decode(ids)).hexdigest()) for ids, _ in encode_rows(part, vocab)]
                n, sha, back = zip(*rows)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha), "decoded_sha256": pa.array(back)})

    return run


def _encodings(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(name)
        for batch in batches:
            for part in chunks(batch, "text"):
                off = text_buffer(part.column("text"))[1]
                ids, starts = [], []
                for i, (x, cut) in enumerate(encode_rows(part, vocab)):
                    ids.append(x)
                    starts.append(cut - off[i])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32())), "offsets": pa.array(starts, pa.list_(pa.int64()))})

    return run


def _decodings(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(name)
        for batch in batches:
            out = [vocab.decode(np.asarray(x, np.int64)) for x in batch.column("ids").fill_null([]).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "bytes": pa.array(out, pa.binary())})

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, offsets (bytes where pre-tokens start); a null text is empty and has no ids."""
    return docs.select("doc_id", "text").mapInArrow(_encodings(ship(docs, path)), "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes of the ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decodings(ship(encoded, path)), "doc_id long, bytes binary")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, whatever its length; a null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_digests(ship(docs, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
