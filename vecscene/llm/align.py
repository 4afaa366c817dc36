"""Alignment of two tokenizers over the same texts by an event sweep.

Each text is encoded by a byte-level BPE (A) and by a piece model with byte fallback (B).  Every token is an event at the
byte where it ends.  The events of both sides are one table, dealt out by document and sorted inside their partitions by
offset; a machine goes over them and keeps what is open: the tokens since the last byte where both sides ended, the
counters and the running digest of one document.  Where both sides end, a group is closed; between two neighbouring
ends one token of each side covers the text, which is one link.

Events travel in blocks: those of one side that end within the same BLOCK bytes are one row with the ids and the block's
offset, so their ends follow from the sizes of the tokens.  Links meet their corpus-wide counts in buckets of pairs, each of
a bounded size, which the tasks hold while the documents' links stream past; no table of pairs is broadcast.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from .bpe import ship
from .common import chunks, materialize, text_buffer

#: Bytes of text whose events of one side are one row.
BLOCK = 1 << 14
#: Tokens that the machine takes in at once, and links that a task adds up before it gives them on.
TOKENS, HELD = 1 << 20, 1 << 21
#: Pairs of one bucket, and of one row of it.
BUCKET, ROW = 1 << 18, 1 << 15


def _unmapped() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(x for x in range(256) if x not in set(plain))}


class Side:
    """A vocabulary: encode gives the ids of texts; bytes of ids by gathering."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(x) for x in pieces], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        begin = np.cumsum(size) - size
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.at[ids] - begin, size)]


class ByteSide(Side):
    """A byte-level BPE file in JSON.  Where its merges are in the order of their ids, which is checked, the ids are ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            told = json.load(f)
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        byte = _unmapped()
        pieces = [b""] * (max(vocab.values()) + 1)
        special = {x["content"] for x in told.get("added_tokens", ())}
        ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items() if k not in special}
        for k, v in ranks.items():
            pieces[v] = k
        super().__init__(pieces)
        order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if order == sorted(order) and set(range(256)) == {ranks[bytes([i])] for i in range(256)}:
            coder = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._one = coder.encode_ordinary
        else:
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(path)
            coder.encode_special_tokens = True
            self._one = lambda text: coder.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self._one(" " + x), np.int64) for x in texts]


class PieceSide(Side):
    """A piece model; it puts the space before the text itself."""

    def __init__(self, path: str):
        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.coder.get_piece_size()
        told = [self.coder.id_to_piece(i) for i in range(n)]
        super().__init__([bytes([int(x[3:5], 16)]) if self.coder.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(told)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.coder.encode(texts, num_threads=1)] if texts else []


@functools.lru_cache(maxsize=2)
def _sides(a: str, b: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(SparkFiles.get(a)), PieceSide(SparkFiles.get(b))


def _pack(ids: np.ndarray) -> bytes:
    return zstandard.compress(ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4").tobytes(), 1)


def _unpack(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.decompress(data)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


EVENTS = "rid long, doc_id long, at long, side int, n int, ids binary"


def _whole(side: Side, ids: list[np.ndarray], raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which texts the tokens of their ids spell byte for byte; raw holds all texts one after another."""
    flat = np.concatenate([np.zeros(0, np.int64), *ids])
    n = np.array([len(x) for x in ids])
    total = np.concatenate([[0], np.cumsum(side.size[flat])])
    edge = np.append(0, np.cumsum(n))
    same = total[edge[1:]] - total[edge[:-1]] == size
    if same.all() and np.array_equal(side.joined(flat), raw):
        return same
    at = np.cumsum(size) - size
    return np.array([bool(s) and np.array_equal(side.joined(x), raw[a : a + m]) for s, x, a, m in zip(same, ids, at, size)], bool)


def _encode(a_name: str, b_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(a_name, b_name)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = [x or "" for x in part.column("text").to_pylist()]
                data, off = text_buffer(part.column("text"))
                size = np.diff(off) + 1
                raw = np.insert(data, off[:-1], 32)
                ids = [s.encode(texts) for s in sides]
                good = (size > 1) & _whole(sides[0], ids[0], raw, size) & _whole(sides[1], ids[1], raw, size)
                rows = []
                for i, (rid, doc_id) in enumerate(zip(part.column("rid").to_pylist(), part.column("doc_id").to_pylist())):
                    if not good[i]:
                        rows.append((rid, doc_id, 0, 0, 0, None))
                        continue
                    for k, s in enumerate(sides):
                        x = ids[k][i]
                        block = (np.cumsum(s.size[x]) - 1) // BLOCK
                        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist()
                        rows += [(rid, doc_id, int(block[p]) * BLOCK, k, q - p, _pack(x[p:q])) for p, q in zip(cut, [*cut[1:], len(x)])]
                yield pa.RecordBatch.from_pydict(dict(zip(("rid", "doc_id", "at", "side", "n", "ids"), (pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))))))

    return run


def events(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The end events of both sides as blocks, as EVENTS says; a text without tokens has one empty row.

    rid tells the rows of docs apart, so repeated doc_ids do not mix.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return rows.mapInArrow(_encode(ship(docs, a_path), ship(docs, b_path)), EVENTS)


class _Open:
    """The document that the machine is in."""

    def __init__(self, rid: int, doc_id: int | None):
        self.rid, self.doc_id, self.sha, self.begun, self.end = rid, doc_id, hashlib.sha256(), False, 0
        self.counts = np.zeros(4, np.int64)  # tokens of A and of B, groups, links


@functools.cache
def _decimals() -> np.ndarray:
    """A place for the sign before a number, then the digits of the numbers below 100,000, right-aligned."""
    n = np.arange(100_000)
    return np.column_stack([np.zeros(100_000, np.int64), *[48 + n // 10 ** (4 - j) % 10 for j in range(5)]]).astype(np.uint8)


def _spelled(ids: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each sign and the decimal id behind it, and the number of bytes of each."""
    if ids.max(initial=0) >= 100_000:
        parts = [bytes([s]) + b"%d" % i for s, i in zip(sign.tolist(), ids.tolist())]
        return np.frombuffer(b"".join(parts), np.uint8), np.array([len(x) for x in parts])
    digits = 1 + (ids >= 10) + (ids >= 100) + (ids >= 1000) + (ids >= 10000)
    grid = _decimals()[ids]
    grid[:, 0] = sign
    keep = np.arange(6)[None, :] >= (6 - digits)[:, None]
    keep[:, 0] = True
    return grid[keep], digits + 1


class Machine:
    """The sweep over sorted events.  Each call of take gives what the events so far have closed."""

    def __init__(self, a: Side, b: Side):
        self.sides = (a, b)
        self.open: _Open | None = None
        self.left = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # ids since the last common end

    def take(self, rids: list, doc_ids: list, sides: np.ndarray, n: np.ndarray, ids: list) -> tuple:
        """Documents touched; a, b (closed tokens' ids), their documents (places in that list), groups and ends."""
        docs = [self.open] if self.open else []
        place = np.zeros(len(rids), np.int64)
        for i, (rid, doc_id) in enumerate(zip(rids, doc_ids)):
            if not docs or docs[-1].rid != rid:
                docs.append(_Open(rid, doc_id))
            place[i] = len(docs) - 1
        flat, of = [], []
        for k in (0, 1):
            own = [i for i in np.flatnonzero((sides == k) & (n > 0))]
            flat.append(np.concatenate([self.left[k], *[_unpack(ids[i], int(n[i])) for i in own]]))
            of.append(np.concatenate([np.zeros(len(self.left[k]), np.int64), np.repeat(place[own], n[own])]))
        ends = [np.cumsum(s.size[x]) for s, x in zip(self.sides, flat)]
        other = [np.searchsorted(ends[1 - k], ends[k]) for k in (0, 1)]  # the other side's token that holds this end
        common = [np.append(ends[1 - k], -1)[other[k]] == ends[k] for k in (0, 1)]
        closed = [int(np.flatnonzero(c)[-1]) + 1 if c.any() else 0 for c in common]
        self.left = tuple(x[m:].copy() for x, m in zip(flat, closed))
        flat, of, ends, other, common = ([x[k][: closed[k]] for k in (0, 1)] for x in (flat, of, ends, other, common))
        self.open = docs[-1] if docs else None
        return docs, flat, of, ends, other, common

    def digest(self, docs, flat, of, common, other) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Move counters and digests of docs on; the sorted links as (document, pair of ids, number)."""
        m = len(docs)
        group = [np.cumsum(c) - c for c in common]
        for k in (0, 1):
            for d, x in zip(docs, np.bincount(of[k], minlength=m)):
                d.counts[k] += x
        for d, x in zip(docs, np.bincount(of[0][common[0]], minlength=m)):
            d.counts[2] += x
        # A's token at each of A's ends, and B's at those of its ends that are not A's
        alone = ~common[1]
        a = np.concatenate([flat[0], flat[0][other[1][alone]]])
        b = np.concatenate([flat[1][other[0]], flat[1][alone]])
        doc = np.concatenate([of[0], of[1][alone]])
        wide = len(self.sides[1].size)
        key = doc * (len(self.sides[0].size) * wide) + a * wide + b
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        number = np.diff(np.append(first, len(key)))
        for d, x in zip(docs, np.bincount(doc, minlength=m)):
            d.counts[3] += x
        # text of the groups: a sign, then the id; A's tokens of a group before B's
        n_groups = int(common[0].sum())
        before = [np.concatenate([[0], np.cumsum(np.bincount(group[k], minlength=n_groups))]) for k in (0, 1)]
        to = [np.arange(len(flat[0])) + before[1][group[0]], np.arange(len(flat[1])) + before[0][group[1] + 1]]
        ids, sign, owner = (np.empty(len(flat[0]) + len(flat[1]), t) for t in (np.int64, np.uint8, np.int64))
        for k in (0, 1):
            ids[to[k]], owner[to[k]] = flat[k], of[k]
            sign[to[k]] = np.where(np.append(True, group[k][1:] != group[k][:-1])[: len(group[k])], (59, 124)[k], 44)
        told, size = _spelled(ids, sign)
        edge = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(owner, np.arange(m + 1))]
        for d, p, q in zip(docs, edge.tolist(), edge[1:].tolist()):
            if q > p:
                d.sha.update(told[p if d.begun else p + 1 : q])
                d.begun = True
        return key[first] // (len(self.sides[0].size) * wide), key[first] % (len(self.sides[0].size) * wide), number


SWEPT = "rid long, doc_id long, pairs array<long>, n array<int>, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    total = np.cumsum(batch.column("n").to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOKENS, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _taken(machine: Machine, part: pa.RecordBatch) -> tuple:
    column = lambda c: part.column(c).to_pylist()
    return machine.take(column("rid"), column("doc_id"), part.column("side").to_numpy(), part.column("n").to_numpy(), column("ids"))


def _list(values: np.ndarray, edge: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values, kind))


def _swept(a_name: str, b_name: str):
    def record(docs: list[_Open], done: int, doc: np.ndarray, pair: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        """A row for each document with links, or that has ended: the first `done`."""
        size = np.bincount(doc, minlength=len(docs))
        take = [i for i in range(len(docs)) if i < done or size[i]]
        told = [docs[i].counts.tolist() if i < done else [None] * 4 for i in take]
        sha = [(docs[i].sha.hexdigest() if docs[i].begun else "") if i < done else None for i in take]
        edge = np.append(0, np.cumsum(size[take]))
        whole = [_list(pair, edge, pa.int64()), _list(number, edge, pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([docs[i].rid for i in take], pa.int64()), pa.array([docs[i].doc_id for i in take], pa.int64()), *whole, *[pa.array([x[j] for x in told], pa.int64()) for j in range(4)], pa.array(sha, pa.string())], [x.split(" ")[0] for x in SWEPT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*_sides(a_name, b_name))
        for batch in batches:
            for part in _slices(batch):
                docs, flat, of, _, other, common = _taken(machine, part)
                yield record(docs, len(docs) - 1, *machine.digest(docs, flat, of, common, other))
        if machine.open:
            none = np.zeros(0, np.int64)
            yield record([machine.open], 1, none, none, none)

    return run


def _grouped(a_name: str, b_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*_sides(a_name, b_name))
        for batch in batches:
            for part in _slices(batch):
                docs, flat, of, ends, _, common = _taken(machine, part)
                size = [np.bincount(np.cumsum(c) - c, minlength=int(common[0].sum())) for c in common]
                doc, end = of[0][common[0]], ends[0][common[0]]
                begin = np.append(0, end[:-1])[: len(end)]
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)])
                for i, p, q in zip(doc[first].tolist(), first.tolist(), [*first[1:].tolist(), len(doc)]):  # offsets inside the document
                    shift = docs[i].end - begin[p]
                    begin[p:q] += shift
                    end[p:q] += shift
                    docs[i].end = int(end[q - 1])
                edge = [np.append(0, np.cumsum(x)) for x in size]
                yield pa.RecordBatch.from_arrays([pa.array([docs[i].rid for i in doc], pa.int64()), pa.array([docs[i].doc_id for i in doc], pa.int64()), pa.array(begin), pa.array(end), *[_list(x, e, pa.int32()) for x, e in zip(flat, edge)]], ["rid", "doc_id", "begin", "end", "a_ids", "b_ids"])

    return run


def _sorted(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return events(docs, a_path, b_path).repartition("rid").sortWithinPartitions("rid", "at", "side")


def _names(*paths: str) -> tuple[str, ...]:
    return tuple(p.rsplit("/", 1)[-1] for p in paths)


def sweep(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows as SWEPT says: links of a document in one or more rows, as pairs (A's id times B's number of ids, plus B's id) and
    how often; the row that ends a document also has its figures."""
    return _sorted(docs, a_path, b_path).mapInArrow(_swept(*_names(a_path, b_path)), SWEPT)


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """rid, doc_id, begin, end (bytes of space and text), a_ids, b_ids: a row for each group, none for texts without tokens."""
    return _sorted(docs, a_path, b_path).mapInArrow(_grouped(*_names(a_path, b_path)), "rid long, doc_id long, begin long, end long, a_ids array<int>, b_ids array<int>")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of pairs added up as far as HELD of them go."""
    held, size = [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        pair, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return pair, np.bincount(at, np.concatenate([y for _, y in held]), len(pair)).astype(np.int64)

    record = lambda pair, n: pa.RecordBatch.from_pydict({"pair": pair, "n": n})
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("pairs").flatten().to_numpy(), batch.column("n").flatten().to_numpy()))
            size += len(held[-1][0])
        if size > 2 * HELD:
            held = [flush()]
            size = len(held[0][0])
            if size > HELD:
                yield record(*held[0])
                held, size = [], 0
    if size:
        yield record(*flush())


def pair_counts(swept: DataFrame, wide: int) -> DataFrame:
    """pair, n (links corpus-wide), best (no pair of the same B id has more): a table."""
    added = materialize(swept.select("pairs", "n").mapInArrow(_added, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    top = added.groupBy(F.pmod("pair", F.lit(wide)).alias("b")).agg(F.max("n").alias("top"))
    return added.join(top, F.pmod(added["pair"], F.lit(wide)) == top["b"]).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket, salt and kind: the counts of a bucket, then links, which take theirs."""
    key, parts, table = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "salt", "kind")], 1)
        cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))[: len(keys)])
        for p, q in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]):
            rows = batch.slice(p, q - p)
            pair, n = rows.column("pairs").flatten().to_numpy(), rows.column("n").flatten().to_numpy()
            if tuple(keys[p, :2]) != key:
                key, parts, table = tuple(keys[p, :2]), [], None
            if keys[p, 2] == 0:
                parts.append((pair, n, rows.column("best").flatten().to_numpy(zero_copy_only=False)))
                continue
            if table is None:
                pairs, count, best = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(pairs)
                table, parts = (pairs[order], count[order], best[order].astype(np.int64)), []
            at = np.searchsorted(table[0], pair)
            edge = np.append(0, np.cumsum([len(x) for x in rows.column("pairs")]))
            sums = [np.append(0, np.cumsum(n * x[at])) for x in table[1:]]
            yield pa.RecordBatch.from_pydict({"rid": rows.column("rid"), "count_sum": sums[0][edge[1:]] - sums[0][edge[:-1]], "n_best": sums[1][edge[1:]] - sums[1][edge[:-1]]})


def _dealt(buckets: int, salts: int):
    """The links of each row once for each bucket that they fall in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) for x in batch.column("pairs")], np.int64)
            pair, n = batch.column("pairs").flatten().to_numpy(), batch.column("n").flatten().to_numpy()
            rid = batch.column("rid").to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            bucket = pair % buckets
            if buckets > 1:
                order = np.lexsort((bucket, row))
                pair, n, row, bucket = pair[order], n[order], row[order], bucket[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1]))[: len(row)])
            edge = np.append(first, len(row))
            if len(first):
                k = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array((rid[row[first]] % salts).astype(np.int32)), pa.array(np.ones(k, np.int32)), pa.array(rid[row[first]]), _list(pair, edge, pa.int64()), _list(n, edge, pa.int64()), pa.nulls(k, pa.list_(pa.bool_()))], ["bucket", "salt", "kind", "rid", "pairs", "n", "best"])

    return run


def scores(swept: DataFrame, wide: int) -> DataFrame:
    """rid, n_best, count_sum of each document with links."""
    spark = swept.sparkSession
    counts = materialize(pair_counts(swept, wide))
    buckets = max(1, -(-counts.count() // BUCKET))
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets))
    bucket = F.pmod("pair", F.lit(buckets)).cast("int")
    packed = counts.groupBy(bucket.alias("bucket"), F.pmod(F.xxhash64("pair"), F.lit(-(-BUCKET // ROW))).alias("part")).agg(F.collect_list(F.struct("pair", "n", "best")).alias("x"))
    packed = packed.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("rid"), F.col("x.pair").alias("pairs"), F.col("x.n").alias("n"), F.col("x.best").alias("best"))
    links = swept.select("rid", "pairs", "n").mapInArrow(_dealt(buckets, salts), "bucket int, salt int, kind int, rid long, pairs array<long>, n array<long>, best array<boolean>")
    met = packed.unionByName(links).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind").mapInArrow(_met, "rid long, count_sum long, n_best long")
    return met.groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    Null and empty texts, and texts that a side's tokens do not spell byte for byte, have zeros and ''.  Repeated rows are
    aligned one by one, and their links all count; a null doc_id stays null; texts may have any length; an empty table
    gives no rows; other columns are not looked at.
    """
    swept = materialize(sweep(docs, a_path, b_path))
    wide = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    told = swept.where("groups_sha256 is not null").select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return told.join(scores(swept, wide), "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
