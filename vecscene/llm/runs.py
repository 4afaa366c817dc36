"""Periodic runs of words, found as Gusfield and Stoye find tandem repeats, over many texts at once.

Where every word recurs at the pace that a run of the least exponent asks for, texts are cut into stretches; nothing else can
lie in a run.  The stretches of a chunk stand one after another in one sequence, each closed by a sign of its own, and

1. names of all factors of 1, 2, 4, ... words (prefix doubling) give the order of the suffixes and the common extension of
   any two places, forwards and backwards;
2. Lempel-Ziv blocks follow from the longest earlier factor at each place; at the borders of each block and for each length,
   extensions give squares that cover the leftmost one of every kind;
3. squares are loci of the suffix tree, here intervals of suffixes.  From each, a suffix-link walk goes on to the square that
   starts one word later: in the text as far as its own extension reaches, from there by a descent from the suffix link's
   locus.  Loci met before end a walk.  This completes the vocabulary;
4. the leaves below each locus are the places of its square, and neighbouring places of one period merge into a run.

All steps are array operations; a text is never taken apart word by word in Python.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, chunks

#: Least length, and least length in periods, of a run.
LENGTH, EXPONENT = 6, 4


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    there = key[order]
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(np.append(False, there[1:] != there[:-1])[: len(key)])
    return out


def _lows(v: np.ndarray) -> list[np.ndarray]:
    """Level t has the minimum of the 2^t values that end at each place (of those that exist)."""
    out, k = [v], 1
    while k < len(v):
        low = out[-1].copy()
        np.minimum(out[-1][k:], out[-1][:-k], out=low[k:])
        out.append(low)
        k *= 2
    return out


def _reach(lows: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Going left from each place (included): the first whose value is below `least`; -1 if none is."""
    at = at.copy()
    for t in range(len(lows) - 1, -1, -1):
        at = np.where((at >= 0) & (lows[t][np.maximum(at, 0)] >= least), at - (1 << t), at)
    return np.maximum(at, -1)


class Suffixes:
    """The suffixes of a sequence whose last word is found once, as a tree: intervals of their order."""

    def __init__(self, s: np.ndarray):
        n = self.n = len(s)
        names = [_dense(s)]
        while int(names[-1].max(initial=-1)) + 1 < n:
            k = 1 << (len(names) - 1)
            key = names[-1].astype(np.int64) * (n + 1)
            key[: n - k] += names[-1][k:] + 1
            names.append(_dense(key))
        self.rank = names[-1]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        self.names = [np.append(x, np.int32(-1)) for x in names]
        common = np.zeros(n, np.int64)  # of each suffix and the one before it in order
        common[1:] = self.forward(self.order[:-1], self.order[1:])
        self.common = common
        self.left, self.right = _lows(common), _lows(common[::-1])

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that starts at both of two different places."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for t in range(len(self.names) - 1, -1, -1):
            step = (self.names[t][i] == self.names[t][j]).astype(np.int64) << t
            i += step
            j += step
        return i - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that ends at both (these words included)."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for t in range(len(self.names) - 1, -1, -1):
            a, b = i - (1 << t) + 1, j - (1 << t) + 1
            step = ((a >= 0) & (b >= 0) & (self.names[t][np.maximum(a, 0)] == self.names[t][np.maximum(b, 0)])).astype(np.int64) << t
            i -= step
            j -= step
        return begin - i

    def locus(self, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last suffix that begin with the `size` words at place i."""
        r = self.rank[i].astype(np.int64)
        low = _reach(self.left, r, size)
        high = self.n - 1 - _reach(self.right, self.n - 2 - r, size) - 1
        return np.maximum(low, 0), high

    def child(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A place where the `size` words of a locus are followed by a word (as its name), -1 if there is none."""
        a, b = low.copy(), high + 1
        last = self.n
        while (a < b).any():
            m = (a + b) // 2
            less = self.names[0][np.minimum(self.order[np.minimum(m, self.n - 1)] + size, last)] < word
            go = a < b
            a, b = np.where(go & less, m + 1, a), np.where(go & ~less, m, b)
        at = self.order[np.minimum(a, self.n - 1)]
        return np.where((a <= high) & (self.names[0][np.minimum(at + size, last)] == word), at, -1)

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks: the longest factor that also starts earlier, or one word."""
        n, order = self.n, self.order
        longest = np.zeros(n, np.int64)
        for way in (slice(None), slice(None, None, -1)):
            v = order[way]
            # the nearest suffix in order that starts earlier
            at = _reach(_lows(v), np.arange(n) - 1, v)
            here = np.flatnonzero(at >= 0)
            i = v[here]
            longest[i] = np.maximum(longest[i], self.forward(i, v[at[here]]))
        out, at, step = [], 0, np.maximum(longest, 1).tolist()
        while at < n:
            out.append(at)
            at += step[at]
        return np.array(out, np.int64)


def _each(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, ..., size - 1 for each, and which it is for."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size), of


def covering(t: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares; the leftmost square of every kind lies in the run of one of them, at it or behind it."""
    h = t.blocks()
    after = np.append(h[1:], t.n)
    size, word = after - h, t.names[0]
    starts, periods = [], []
    # centre and start in the block, end behind it
    k, of = _each(size)
    k += 1
    q, edge = after[of] - k, after[of]
    ok = np.flatnonzero((word[edge] == word[q]) & (edge < t.n))
    k, q, edge = k[ok], q[ok], edge[ok]
    ahead = t.forward(edge, q)
    back = np.where(q > 0, t.backward(edge - 1, np.maximum(q - 1, 0)), 0)
    ok = ahead + back >= k
    starts.append(np.maximum(q - back, q - k + 1)[ok])
    periods.append(k[ok])
    # centre in the block, start before it
    k, of = _each(size + np.append(size[1:], 0))
    k += 1
    h, after = h[of], after[of]
    q = h + k
    ok = np.flatnonzero((q < t.n) & (h > 0))
    ok = ok[(word[h[ok]] == word[q[ok]]) & (word[h[ok] - 1] == word[q[ok] - 1])]
    k, q, h, after = k[ok], q[ok], h[ok], after[ok]
    ahead, back = t.forward(h, q), t.backward(h - 1, q - 1)
    start = np.maximum(h - back, h - k + 1)
    ok = (ahead + back >= k) & (start + k <= after)
    starts.append(start[ok])
    periods.append(k[ok])
    return np.concatenate(starts), np.concatenate(periods)


def primitive(t: Suffixes, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the half of each square is no power of a shorter word."""
    out, rest = np.ones(len(i), bool), k.copy()
    p = 2
    while (todo := np.flatnonzero(out & (rest > 1))).size:
        top = int(rest[todo].max())
        if p * p > top:  # what is left is prime
            d = k[todo] // rest[todo]
            out[todo] &= t.forward(i[todo], i[todo] + d) < 2 * k[todo] - d
            break
        hit = todo[rest[todo] % p == 0]
        if len(hit):
            d = k[hit] // p
            out[hit] &= t.forward(i[hit], i[hit] + d) < 2 * k[hit] - d
            while len(hit):
                rest[hit] //= p
                hit = hit[rest[hit] % p == 0]
        small = out & (rest > 1) & (rest < p * p)  # a prime is left
        hit = np.flatnonzero(small)
        if len(hit):
            d = k[hit] // rest[hit]
            out[hit] &= t.forward(i[hit], i[hit] + d) < 2 * k[hit] - d
            rest[hit] = 1
        p += 1
    return out


def vocabulary(t: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of suffixes and periods, as (first, last, period) columns: one for each kind of square with a primitive half."""
    i, k = covering(t)
    ok = primitive(t, i, k)
    i, k = i[ok], k[ok]
    seen = np.zeros(0, np.int64)
    found = []
    while len(i):
        low, _ = t.locus(i, 2 * k)
        key, at = np.unique(k * t.n + low, return_index=True)
        at = at[~np.isin(key, seen)]
        seen = np.union1d(seen, key)
        i, k = i[at], k[at]
        # squares that start at the next words too, up to one period of them
        more = np.minimum(t.forward(i, i + k) - k, k - 1)
        found.append((i, k, more + 1))
        end = i + more
        ok = np.flatnonzero(more < k - 1)
        end, k = end[ok], k[ok]
        low, high = t.locus(end + 1, 2 * k - 1)
        i = t.child(low, high, 2 * k - 1, t.names[0][end])
        i, k = i[i >= 0], k[i >= 0]
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    i, k, n = (np.concatenate(x) for x in zip(*found))
    step, of = _each(n)
    i, k = i[of] + step, k[of]
    low, high = t.locus(i, 2 * k)
    _, at = np.unique(k * t.n + low, return_index=True)
    return low[at], high[at], k[at]


def merged(t: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of two periods or more, in order of start, then period."""
    low, high, k = vocabulary(t)
    step, of = _each(high - low + 1)
    key = np.sort(k[of] * (t.n + 1) + t.order[low[of] + step])  # the gap keeps periods apart
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1] + 1)[: len(key)])
    period, start = key[first] // (t.n + 1), key[first] % (t.n + 1)
    length = np.diff(np.append(first, len(key))) - 1 + 2 * period
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def stretches(word: np.ndarray, row: np.ndarray, times: int, least: int) -> np.ndarray:
    """A mask of the words that a run of `times` periods and `least` words can hold, within the rows.

    In such a run of period q every word stands among `times` equals within (times - 1) q words.  So for each power of two p,
    runs of periods from p to 2 p lie where that holds for 2 p throughout at least times x p words.
    """
    n = len(word)
    out = np.zeros(n, bool)
    if n < times:
        return out
    order = np.lexsort((word, row))
    w, r = word[order], row[order]
    gap = np.full(n, np.iinfo(np.int64).max)
    span = order[times - 1 :] - order[: n - times + 1]
    same = (w[times - 1 :] == w[: n - times + 1]) & (r[times - 1 :] == r[: n - times + 1])
    span = np.where(same, span, gap[0])
    for j in range(times):
        np.minimum(gap[j : n - times + 1 + j], span, out=gap[j : n - times + 1 + j])
    near = np.empty(n, np.int64)
    near[order] = gap
    p = 1
    at = np.flatnonzero(near < gap.dtype.type(np.iinfo(np.int64).max))
    while len(at) and times * p <= n:
        # places in a row of the mask at this scale
        here = at[near[at] <= (times - 1) * 2 * p]
        if len(here):
            cut = np.flatnonzero(np.append(True, (here[1:] != here[:-1] + 1) | (row[here[1:]] != row[here[:-1]])))
            size = np.diff(np.append(cut, len(here)))
            out[here[np.repeat(size >= max(least, times * p), size)]] = True
        p *= 2
    return out


def runs_of(word: np.ndarray, row: np.ndarray, exponent: float = EXPONENT, least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (place in word), length, period of the runs of at least `exponent` (2 or more) periods and `least` words inside rows.

    word holds the numbers of words, row the ascending numbers of the rows that they are in.
    """
    may = stretches(word, row, int(exponent), least)
    at = np.flatnonzero(may)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])))
    _, names = np.unique(word[at], return_inverse=True)
    # each stretch ends in a sign of its own
    part = np.zeros(len(at), np.int64)
    part[cut] = 1
    part = np.cumsum(part) - 1
    s = np.empty(len(at) + len(cut), np.int64)
    place = np.full(len(s), -1)
    to = np.arange(len(at)) + part
    s[to], place[to] = names, at
    signs = np.append(cut[1:], len(at)) + np.arange(len(cut))
    s[signs] = names.max() + 1 + np.arange(len(cut))
    start, length, period = merged(Suffixes(s))
    ok = (length >= least) & (length >= exponent * period)
    return place[start[ok]], length[ok], period[ok]


def made_periodic(n: np.ndarray, doc_ids: list) -> np.ndarray:
    """For each word of rows of n words, the word of its row (as a place in the chunk) that stands there after the rewrite.

    With h the CRC-32 of the decimal doc_id and g = h // 10, a row whose h ends in 0 repeats, from word g % n on, the next
    1 + (n - g % n) // (3 + g % 8) words.  A null doc_id changes nothing.
    """
    out = np.arange(int(n.sum()))
    begin = np.cumsum(n) - n
    for i, doc_id in enumerate(doc_ids):
        if doc_id is None or not n[i] or (h := zlib.crc32(b"%d" % doc_id)) % 10:
            continue
        g, size = h // 10, int(n[i])
        a = g % size
        p = 1 + (size - a) // (3 + g % 8)
        out[begin[i] + a : begin[i] + size] = begin[i] + a + np.arange(size - a) % p
    return out


def _dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that lie in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _spoken(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after another, each with a space behind it, and the edges between them."""
    size = end - start + 1
    edge = np.append(0, np.cumsum(size))
    out = np.append(data, np.uint8(0))[np.arange(edge[-1]) + np.repeat(start - edge[:-1], size)]
    out[edge[1:] - 1] = 32
    return out, edge


class Periodic:
    """The runs of a chunk of texts: row, start (word number in the row), length, period, by row, start, period."""

    def __init__(self, part: pa.RecordBatch, exponent: float, least: int, rewrite: bool):
        self.words = w = Words(part.column("text"))
        self.n = np.diff(w.ptr)
        self.at = made_periodic(self.n, part.column("doc_id").to_pylist()) if rewrite else np.arange(len(w.hash))
        row = np.repeat(np.arange(len(self.n)), self.n)
        start, self.length, self.period = runs_of(w.hash[self.at], row, exponent, least)
        order = np.lexsort((self.period, start))
        start, self.length, self.period = start[order], self.length[order], self.period[order]
        self.dropped = _dropped(len(row), start, self.length, self.period)
        self.row = row[start]
        self.start = start - w.ptr[self.row]
        self.edge = np.searchsorted(self.row, np.arange(len(self.n) + 1))


def _digests(exponent: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                p = Periodic(part, exponent, least, True)
                kept = np.flatnonzero(~p.dropped)
                at = p.at[kept]
                told, edge = _spoken(p.words.data, p.words.start[at], p.words.end[at])
                cut = edge[np.searchsorted(kept, p.words.ptr)].tolist()
                out = []
                for i, (a, b) in enumerate(zip(p.edge[:-1].tolist(), p.edge[1:].tolist())):
                    best = (None,) * 4
                    text = b""
                    if b > a:
                        k = a + int(p.length[a:b].argmax())  # the first of the longest is the smallest start, then period
                        size, period = int(p.length[k]), int(p.period[k])
                        best = (int(p.start[k]), size, period, 1000 * size // period)
                        text = b"".join(b"%d,%d,%d\n" % x for x in zip(p.start[a:b].tolist(), p.length[a:b].tolist(), p.period[a:b].tolist()))
                    whole = told[cut[i] : max(cut[i], cut[i + 1] - 1)]
                    out.append((b - a, *best, hashlib.sha256(text).hexdigest(), hashlib.sha256(whole).hexdigest()))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.string()) for c in columns[5:]]], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return run


def run_digest(docs: DataFrame, exponent: float = EXPONENT, least: int = LENGTH) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 for every row, after the rewrite.

    Null, empty and blank texts have no words and no runs; repeated rows give repeated rows; of runs of one length the
    smallest start, then the smallest period is told; texts may have any length; an empty table gives no rows; other columns
    are not looked at.
    """
    return docs.select("doc_id", "text").mapInArrow(_digests(exponent, least), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def runs(docs: DataFrame, exponent: float = 2, least: int = 2) -> DataFrame:
    """doc_id, start, length, period (in words) of each run of the texts as they are; no row for a text without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                p = Periodic(part, exponent, least, False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(p.row)), pa.array(p.start), pa.array(p.length), pa.array(p.period)], ["doc_id", "start", "length", "period"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, exponent: float = EXPONENT, least: int = LENGTH) -> DataFrame:
    """doc_id and text with each run cut to its first period, words joined by one space; texts without runs stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                p = Periodic(part, exponent, least, False)
                kept = np.flatnonzero(~p.dropped)
                told, edge = _spoken(p.words.data, p.words.start[kept], p.words.end[kept])
                cut = edge[np.searchsorted(kept, p.words.ptr)].tolist()
                texts = [told[a : b - 1].tobytes().decode() if p.edge[i + 1] > p.edge[i] else t for i, (t, a, b) in enumerate(zip(part.column("text").to_pylist(), cut, cut[1:]))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
