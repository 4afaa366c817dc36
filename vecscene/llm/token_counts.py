"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A leaf is a slot that first holds one pre-token, and later all pre-tokens that an edit put in its place.  Every node sums code
points and tokens, so an edit's place is found from the root, and only the slots touched and their paths change.  Around an
edit a few pre-tokens before and after it are split and encoded anew; where the new starts meet an old one behind the edit, the
rest stays, as the split never looks back past a start.

Trees are kept as rows: the text, and the width and the tokens of each leaf, from which the sums of the inner nodes follow
without any encoding.  build makes them once, update takes them through a batch of edits; count_edited does both in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bpe
from .common import chunks, span_hash, text_buffer

#: Pre-tokens before an edit that it may change (a contraction looks two code points ahead), and those behind it that are tried first.
BEFORE, BEHIND = 3, 6


def starts_in(text: str) -> list[int]:
    """Starts of the pre-tokens of a short text, one code point after the other."""
    points = np.frombuffer((text + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    out, state = [], bpe.S_NEW
    for i, symbol in enumerate(bpe._symbols(points, np.array([len(text)])).tolist()[:-1]):
        if bpe._begins(state, symbol):
            out.append(i)
        state = bpe._step(state, symbol)
    return out


class CountTree:
    def __init__(self, text: str, edges: np.ndarray, tokens: np.ndarray, count):
        """edges: where the pre-tokens of the text start, and its end; tokens: how many tokens each gives; count(piece) counts another one's."""
        self.count, self.source, self.edges = count, text, edges
        self.changed: dict[int, list[str]] = {}
        self.n_slots = max(1, len(edges) - 1)
        n = 1 << (self.n_slots - 1).bit_length()
        self.n, self.encoded = n, 0
        self.points, self.tokens = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
        self.points[n : n + len(edges) - 1] = np.diff(edges)
        self.tokens[n : n + len(edges) - 1] = tokens
        while n > 1:
            n //= 2
            for t in (self.points, self.tokens):
                np.add(t[2 * n : 4 * n : 2], t[2 * n + 1 : 4 * n : 2], out=t[n : 2 * n])

    def slot(self, i: int) -> list[str]:
        """The pre-tokens of a slot; one that no edit touched is a slice of the first text."""
        if (found := self.changed.get(i)) is not None:
            return found
        return [self.source[self.edges[i] : self.edges[i + 1]]] if i + 1 < len(self.edges) else []

    def pieces(self) -> list[str]:
        return [p for i in range(self.n_slots) for p in self.slot(i)]

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def size(self) -> int:
        return int(self.points[1])

    def text(self) -> str:
        return "".join(self.pieces())

    def _find(self, at: int) -> int:
        """The slot that holds code point `at`, or the last."""
        i = 1
        while i < self.n:
            i *= 2
            if at >= self.points[i]:
                at -= self.points[i]
                i += 1
        return min(i - self.n, self.n_slots - 1)

    def _before(self, slot: int) -> int:
        """Code points before a slot."""
        i, out = slot + self.n, 0
        while i > 1:
            if i & 1:
                out += int(self.points[i - 1])
            i //= 2
        return out

    def _set(self, slot: int, pieces: list[str]) -> None:
        self.changed[slot] = pieces
        i = slot + self.n
        self.points[i] = sum(map(len, pieces))
        self.tokens[i] = sum(map(self.count, pieces))
        self.encoded += len(pieces)
        while i > 1:
            i //= 2
            for t in (self.points, self.tokens):
                t[i] = t[2 * i] + t[2 * i + 1]

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        """Put `inserted` in the place of `deleted` code points from `start`; both are clipped to the text."""
        start = min(max(start, 0), self.size)
        deleted = min(max(deleted, 0), self.size - start)
        if not deleted and not inserted:
            return
        low = self._find(max(start - 1, 0))
        have = 0
        while low > 0 and have < BEFORE:
            low -= 1
            have += len(self.slot(low))
        begin = self._before(low)
        high, behind = self._find(start + deleted), BEHIND
        while True:
            have = 0
            while high + 1 < self.n_slots and have < behind:
                high += 1
                have += len(self.slot(high))
            old = "".join(p for i in range(low, high + 1) for p in self.slot(i))
            new = old[: start - begin] + inserted + old[start - begin + deleted :]
            starts = starts_in(new)
            if high + 1 == self.n_slots:
                cut = [*starts, len(new)]
                self._put(low, high, [new[a:b] for a, b in zip(cut, cut[1:])])
                return
            shift = len(inserted) - deleted
            at, meets = 0, None
            edges = {}
            for slot in range(low, high + 1):
                if self.slot(slot):
                    edges.setdefault(at + shift, slot)
                at += int(self.points[slot + self.n])
            for s in starts[: -BEFORE or None]:
                if s >= start - begin + len(inserted) and edges.get(s, 0) > low:
                    meets = s
                    break
            if meets is not None:
                cut = [s for s in starts if s < meets] + [meets]
                self._put(low, edges[meets] - 1, [new[a:b] for a, b in zip(cut, cut[1:])])
                return
            behind *= 2

    def _put(self, low: int, high: int, pieces: list[str]) -> None:
        """New content of the slots low to high, dealt out one by one, the last takes the rest."""
        for slot in range(low, high + 1):
            mine = pieces[slot - low : slot - low + 1] if slot < high else pieces[slot - low :]
            if mine != self.slot(slot):
                self._set(slot, mine)


    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Width and tokens of each pre-token, as a tree of the edited text begins with; none is encoded again."""
        widths, tokens = [], []
        for i in range(self.n_slots):
            pieces = self.slot(i)
            widths += map(len, pieces)
            tokens += [int(self.tokens[self.n + i])] if len(pieces) == 1 else [self.count(p) for p in pieces]
        return np.array(widths, np.int32), np.array(tokens, np.int32)


def _in_order(edits: list[dict]) -> list[tuple]:
    """Edits by seq; those of one seq by place, deletions and insertion."""
    return sorted((e["seq"] or 0, e["start"] or 0, e["n_deleted"] or 0, e["inserted"] or "") for e in edits)


def _encoded(part: pa.RecordBatch, vocab):
    """For each row: its text, where its pre-tokens start (and its end) in code points, and their numbers of tokens."""
    raw, cut, ptr = bpe.pretokens(part.column("text"))
    start, end = cut[:-1], cut[1:]
    _, first, which = np.unique(span_hash(np.frombuffer(raw, np.uint8), start, end), return_index=True, return_inverse=True)
    sizes = np.array([len(x) for x in vocab.ids([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])], np.int64)[which]
    lead = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    points = lead[cut]  # the same starts in code points
    for a, b in zip(ptr.tolist(), ptr[1:].tolist()):
        yield lambda a=a, b=b: raw[cut[a] : cut[b]].decode(), points[a : b + 1] - points[a], sizes[a:b]


_FIGURES = ("n_edits", "n_tokens_before", "n_tokens", "n_pretokens", "n_reencoded")


def _counts(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe._vocabulary(name)
        one = lambda piece: len(vocab.ids([piece.encode()])[0])
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for edits, (text, edges, tokens) in zip(part.column("edits").to_pylist(), _encoded(part, vocab)):
                    before = int(tokens.sum())
                    if not edits:
                        rows.append((0, before, before, len(tokens), 0))
                        continue
                    tree = CountTree(text(), edges, tokens, one)
                    for _, start, deleted, inserted in _in_order(edits):
                        tree.edit(start, deleted, inserted)
                    rows.append((len(edits), before, tree.total, len(tokens), tree.encoded))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | {k: pa.array(v, pa.int64()) for k, v in zip(_FIGURES, zip(*rows))})

    return run


def _built(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe._vocabulary(name)
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = [(np.diff(edges).astype(np.int32), tokens.astype(np.int32)) for _, edges, tokens in _encoded(part, vocab)]
                widths, tokens = (pa.array(list(x), pa.list_(pa.int32())) for x in zip(*rows))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text": part.column("text"), "widths": widths, "tokens": tokens})

    return run


def _updated(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe._vocabulary(name)
        one = lambda piece: len(vocab.ids([piece.encode()])[0])
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for text, widths, tokens, edits in zip(*(part.column(c).to_pylist() for c in ("text", "widths", "tokens", "edits"))):
                    tree = CountTree(text, np.append(0, np.cumsum(widths)).astype(np.int64), np.array(tokens, np.int64), one)
                    before = tree.total
                    for _, start, deleted, inserted in _in_order(edits or []):
                        tree.edit(start, deleted, inserted)
                    encoded = tree.encoded
                    rows.append((tree.text(), *tree.leaves(), len(edits or []), before, tree.total, len(tokens), encoded))
                text, widths, tokens, *figures = zip(*rows)
                lists = [pa.array(list(x), pa.list_(pa.int32())) for x in (widths, tokens)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(text, pa.string()), *lists, *[pa.array(x, pa.int64()) for x in figures]], ["doc_id", "text", "widths", "tokens", *_FIGURES])

    return run


_TREE = "doc_id long, text string, widths array<int>, tokens array<int>"
_COUNTS = ", ".join(f"{x} long" for x in _FIGURES)


def _with_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows and the edits of each; rows without doc_id, which have none, are dealt by their text, not all into one task."""
    per = edits.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set(F.struct("seq", "start", "n_deleted", "inserted")).alias("edits"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
    return rows.withColumn("_at", spread).join(per.withColumn("_at", F.lit(0).cast("long")), ["doc_id", "_at"], "left").drop("_at")


def build(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, widths, tokens: the tree of each row, to be written and kept.  A null text is empty and has no leaves."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_built(bpe.ship(docs, path)), _TREE)


def update(trees: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """The trees after a batch of edits, and the figures of count_edited; only what edits touch is encoded."""
    return _with_edits(trees.select("doc_id", "text", "widths", "tokens"), edits).mapInArrow(_updated(bpe.ship(trees, path)), f"{_TREE}, {_COUNTS}")


def count_edited(docs: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """doc_id, n_edits, n_tokens_before, n_tokens, n_pretokens, n_reencoded for every row of docs.

    edits (doc_id, seq, start, n_deleted, inserted) apply in order of seq, start counting code points of the text as it then
    is; edits of one seq by start, n_deleted and inserted, equal edits once.  Places beyond the text are clipped, null
    numbers are 0 and null strings empty, edits of unknown documents do nothing.  Null texts are empty, texts may have any
    length.  Each row of a repeated doc_id gets all edits of that id, a null doc_id none.  An empty table gives no rows;
    other columns are not looked at.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _with_edits(rows, edits).mapInArrow(_counts(bpe.ship(docs, path)), f"doc_id long, {_COUNTS}")
