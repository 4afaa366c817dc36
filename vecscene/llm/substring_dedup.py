"""Substring dedup by De Bruijn compaction over word windows.

Edges are the k-word windows of all documents.  They travel in pieces: edges that follow one another and share their
smallest m-word anchor, so a passage that many documents hold is cut at the same places in all of them.

1. Anchors are counted over all documents; an anchor found once can hold no repeated edge.
2. A piece whose anchor repeats is keyed by its content.  Joins give each content its first source, and the contents that
   stand before and after it wherever it stands: its degrees in the graph.
3. Contents that always follow one another compact: a join marks the heads of nonbranching paths, and a path keeps the
   coordinates (document, first word, number of edges) of its first source.  All documents of one content on a path hold
   the path as a whole, so only heads meet the documents again.
4. Where an anchor has several contents (a branch), the first holders' pieces are opened into single edges, and each edge
   finds its first source by itself (later holders of a piece lie inside it as a whole).
5. The words at a path's source coordinates are read and digested there, and a later document loses a span only if its own
   words give the same digest.

Keys join two independent hashes (48-bit anchor, 64-bit content).  Counts and minima are pre-aggregated before each
shuffle, and both sides of the joins that a hot passage makes uneven are written first, so that adaptive execution can
split them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import BLANK, Words, chunks, discard, grams, materialize, mix, signed

#: Low bits of a coordinate hold the number of edges, the others the first word.
_BITS = 16
_MOST = (1 << _BITS) - 1


def _pieces(w: Words, k: int, m: int):
    """Path pieces of a chunk: row, first edge (word index in the chunk), number of edges, anchor, content hash."""
    starts = w.starts_of(k)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint64)
    low = grams(w.hash, m, seed=1)
    span = k - m + 1
    step, have = low, 1
    while have * 2 <= span:
        step = np.minimum(step[:-have], step[have:])
        have *= 2
    if have < span:
        step = np.minimum(step[: len(step) - (span - have)], step[span - have :])
    anchor = step[starts] >> np.uint64(16)
    edge = grams(w.hash, k, seed=2)[starts]
    row = w.row_of(starts)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    if size.max(initial=0) > _MOST:  # a very long periodic run: cut it
        first = np.concatenate([np.arange(f, f + n, _MOST) for f, n in zip(first, size)])
        size = np.diff(np.append(first, len(starts)))
    at = np.arange(len(starts)) - np.repeat(first, size)
    content = np.add.reduceat(mix(edge + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
    return row[first], starts[first], size, anchor[first], mix(content + size.astype(np.uint64)), edge


def _anchors(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, _, _, anchor, _, _ = _pieces(Words(part.column("text")), k, m)
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                keep = np.ones(len(row), bool)
                keep[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                yield pa.RecordBatch.from_pydict({"anchor": signed(anchor[keep])})

    return run


def _places(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column("text"))
                row, start, size, anchor, content, _ = _pieces(w, k, m)
                ids, tids = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tid"))
                yield pa.RecordBatch.from_pydict({"anchor": signed(anchor), "content": signed(content), "doc_id": ids[row], "tid": tids[row], "at": ((start - w.ptr[row]) << _BITS) | size})

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each element of a list column the row it is in, and the elements."""
    lists = column.fill_null([])
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _joined(w: Words) -> tuple[bytes, np.ndarray]:
    """The bytes of all words, a space after each, and where each word begins."""
    size = w.end - w.start
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    body = w.data[~BLANK[w.data]]
    out[np.arange(len(body)) + np.repeat(np.arange(len(size)), size)] = body
    return out.tobytes(), np.append(0, np.cumsum(size + 1))


def _digest(joined: bytes, begin: np.ndarray, first: int, n: int) -> bytes:
    return hashlib.blake2b(joined[begin[first] : begin[first + n]], digest_size=16).digest()


def _sources(k: int, m: int):
    """Single edges of the pieces in column `open`, and digests of the words at the paths' coordinates in column `paths`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column("text"))
                row, start, size, anchor, _, edge = _pieces(w, k, m)
                of, wanted = _lists(part.column("open"))
                wanted = wanted.to_numpy(zero_copy_only=False)
                piece = np.searchsorted(start, w.ptr[of] + (wanted >> _BITS))
                begin = np.cumsum(size) - size
                n = size[piece]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                ids, tids = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tid"))
                none = pa.nulls(len(inner), pa.binary())
                yield pa.RecordBatch.from_pydict({"anchor": signed(np.repeat(anchor[piece], n)), "key": signed(edge[np.repeat(begin[piece], n) + inner]), "doc_id": np.repeat(ids[of], n), "tid": np.repeat(tids[of], n), "word": np.repeat(wanted >> _BITS, n) + inner, "digest": none})
                of, paths = _lists(part.column("paths"))
                if len(of):
                    joined, at = _joined(w)
                    field = lambda name: paths.field(name).to_numpy(zero_copy_only=False)
                    first, n = field("first") + w.ptr[of], field("n") + k - 1
                    digests = [_digest(joined, at, f, x) for f, x in zip(first.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_pydict({"anchor": field("anchor"), "key": field("content"), "doc_id": ids[of], "tid": tids[of], "word": field("first"), "digest": pa.array(digests, pa.binary())})

    return run


def _cover(part: pa.RecordBatch, k: int) -> tuple[Words, np.ndarray]:
    """The words of a chunk and which of them go: those of verified spans, and of single edges."""
    w = Words(part.column("text"))
    step = np.zeros(len(w.hash) + 1, np.int64)
    of, spans = _lists(part.column("gone"))
    if len(of):
        joined, at = _joined(w)
        first, n = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n"))
        lo = w.ptr[of] + first
        hi = lo + n + k - 1
        same = [h <= end and _digest(joined, at, f, h - f) == d for f, h, end, d in zip(lo.tolist(), hi.tolist(), w.ptr[of + 1].tolist(), spans.field("digest").to_pylist())]
        np.add.at(step, lo[same], 1)
        np.add.at(step, hi[same], -1)
    of, edges = _lists(part.column("gone_edges"))
    lo = w.ptr[of] + edges.to_numpy(zero_copy_only=False)
    lo = lo[lo + k <= w.ptr[of + 1]]
    np.add.at(step, lo, 1)
    np.add.at(step, lo + k, -1)
    return w, np.cumsum(step[:-1]) > 0


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w, gone = _cover(part, k)
                data = w.data.tobytes()
                out = []
                for i in range(len(w)):
                    a, b = w.ptr[i], w.ptr[i + 1]
                    cut = gone[a:b]
                    s, e = w.start[a:b][~cut].tolist(), w.end[a:b][~cut].tolist()
                    out.append((b - a, int(cut.sum()), hashlib.sha256(b" ".join([data[x:y] for x, y in zip(s, e)])).hexdigest()))
                total, removed, sha = zip(*out)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return run


def _texts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w, gone = _cover(part, k)
                old = part.column("text")
                out = []
                for i in range(len(w)):
                    a, b = w.ptr[i], w.ptr[i + 1]
                    cut = gone[a:b]
                    if not cut.any():
                        out.append(old[i].as_py())
                        continue
                    keep = np.ones(w.off[i + 1] - w.off[i], np.int8)
                    # a word goes together with the blanks before it
                    lo = np.where(np.arange(b - a) > 0, np.append(w.off[i], w.end[a:b][:-1]), w.off[i])
                    step = np.zeros(len(keep) + 1, np.int64)
                    np.add.at(step, lo[cut] - w.off[i], 1)
                    np.add.at(step, w.end[a:b][cut] - w.off[i], -1)
                    keep = np.cumsum(step[:-1]) == 0
                    out.append(w.data[w.off[i] : w.off[i + 1]][keep].tobytes().decode())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text": pa.array(out, pa.string())})

    return run


def removals(docs: DataFrame, k: int = 13, m: int = 5) -> DataFrame:
    """doc_id, tid (hash of the text), gone (spans: first word, number of windows, digest), gone_edges (first words of windows).

    A window goes if the same k words also start in a document with a smaller doc_id.  Rows with a null doc_id take no
    part.  Rows of one doc_id are one document's and never remove each other, whether their texts are equal or not; each
    has coordinates of its own, by the hash of its text.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null").withColumn("tid", F.xxhash64("text"))
    anchors = materialize(docs.select("text").mapInArrow(_anchors(k, m), "anchor long").groupBy("anchor").count().where("count > 1").select("anchor"))
    places = materialize(docs.mapInArrow(_places(k, m), "anchor long, content long, doc_id long, tid long, at long").join(anchors, "anchor"))
    discard(anchors)
    first = materialize(places.groupBy("anchor", "content").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")))
    branch = materialize(first.groupBy("anchor").agg(F.count("*").alias("contents")))
    known = materialize(first.join(branch, "anchor").where("source < last or contents > 1"))
    discard(first, branch)
    judged = materialize(places.join(known, ["anchor", "content"]))
    discard(places, known)

    # what stands before and after each piece of a repeated content; rows that are equal count once
    by_row = Window.partitionBy("doc_id", "tid").orderBy("at")
    word, size = F.shiftright("at", _BITS), F.col("at").bitwiseAND(_MOST)
    after = F.lead(F.struct(word.alias("word"), "content")).over(by_row)
    before = F.lag(F.struct((word + size).alias("end"), "content")).over(by_row)
    rows = judged.where("source < last").dropDuplicates(["doc_id", "tid", "at"]).repartition("doc_id", "tid")
    rows = rows.withColumn("after", after).withColumn("before", before)
    rows = rows.withColumn("after", F.when(F.col("after.word") == word + size, F.col("after.content"))).withColumn("before", F.when(F.col("before.end") == word, F.col("before.content")))
    only = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))  # noqa: E731  degree one, and no place without a neighbour
    pieces = materialize(rows.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "tid", "at")).alias("s"), F.coalesce(only("before"), F.lit(False)).alias("one_in"), F.coalesce(only("after"), F.lit(False)).alias("one_out"), F.min("before").alias("before")))
    ends = materialize(pieces.where("one_out").select(F.col("content").alias("before")).distinct().withColumn("goes_on", F.lit(True)))
    # pieces with several or no neighbours before them are heads without a look, and so never meet under one key
    linked = pieces.where("one_in").join(ends, "before", "left").select("anchor", "content", "s", F.coalesce("goes_on", F.lit(False)).alias("inner"))
    joined = linked.unionByName(pieces.where("not one_in").select("anchor", "content", "s", F.lit(False).alias("inner"))).select("anchor", "content", "s.*", (~F.col("inner")).cast("int").alias("head"))
    path = F.sum("head").over(by_row)
    paths = joined.withColumn("path", path).groupBy("doc_id", "tid", "path").agg(F.min_by(F.struct("anchor", "content", word.alias("first")), "at").alias("h"), F.sum(size).alias("n"))
    paths = materialize(paths.select("h.*", F.col("doc_id").alias("source"), F.col("tid").alias("source_tid"), "n"))
    discard(pieces, ends)

    spans = materialize(judged.where("doc_id > source").select("anchor", "content", "doc_id", "tid", word.alias("first")).join(paths.select("anchor", "content", "n"), ["anchor", "content"]))
    wanted = paths.groupBy(F.col("source").alias("doc_id"), F.col("source_tid").alias("tid")).agg(F.collect_list(F.struct("anchor", "content", "first", "n")).alias("paths"))
    opened = judged.where("doc_id = source and contents > 1").groupBy("doc_id", "tid").agg(F.collect_set("at").alias("open"))
    wanted = materialize(wanted.join(opened, ["doc_id", "tid"], "full"))
    discard(paths, judged)
    found = materialize(docs.join(wanted, ["doc_id", "tid"]).mapInArrow(_sources(k, m), "anchor long, key long, doc_id long, tid long, word long, digest binary"))
    discard(wanted)

    edges = found.where("digest is null").drop("digest")
    sources = materialize(edges.groupBy("anchor", "key").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last"))
    singles = materialize(edges.join(sources, ["anchor", "key"]).where("doc_id > source").select("doc_id", "tid", "word"))
    digests = found.where("digest is not null").select("anchor", F.col("key").alias("content"), "digest").dropDuplicates(["anchor", "content"])
    checked = materialize(spans.join(digests, ["anchor", "content"]).select("doc_id", "tid", "first", "n", "digest"))
    discard(found, sources, spans)
    gone = checked.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("first", "n", "digest")).alias("gone"))
    out = materialize(gone.join(singles.groupBy("doc_id", "tid").agg(F.collect_set("word").alias("gone_edges")), ["doc_id", "tid"], "full"))
    discard(checked, singles)
    return out


def _marked(docs: DataFrame, k: int, m: int) -> DataFrame:
    """docs with columns gone and gone_edges."""
    marks = removals(docs, k, m).select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid"), F.col("gone").alias("_gone"), F.col("gone_edges").alias("_edges"))
    both = docs.join(marks, (docs["doc_id"] == marks["_doc"]) & (F.xxhash64(docs["text"]) == marks["_tid"]), "left")
    return both.select(*[docs[c] for c in docs.columns], F.col("_gone").alias("gone"), F.col("_edges").alias("gone_edges"))


def dedup_digest(docs: DataFrame, k: int = 13, m: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row, repeated ones too; null and empty texts have no words.

    Of documents with the same windows the one with the smallest doc_id keeps them; an empty table gives no rows; other
    columns are not looked at.
    """
    base = docs.select("doc_id", "text")
    return _marked(base, k, m).mapInArrow(_digests(k), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_texts(docs: DataFrame, k: int = 13, m: int = 5) -> DataFrame:
    """doc_id and text without the covered words and the blanks before them; other texts stay as they are."""
    base = docs.select("doc_id", "text")
    return _marked(base, k, m).mapInArrow(_texts(k), "doc_id long, text string")


def dedup_documents(docs: DataFrame, k: int = 13, m: int = 5) -> DataFrame:
    """docs with column text as dedup_texts leaves it (n_chars, where present, follows); all other columns unchanged."""
    kept = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(c) for c in kept]).alias("rest"))
    new = _marked(rows, k, m).mapInArrow(_with_texts(k), _schema(rows))
    columns = {c: F.col("rest")[c] for c in kept}
    changed = new.select("doc_id", "text", "changed", "rest").withColumns({f"_{i}": v for i, v in enumerate(columns.values())})
    named = {c: F.col(f"_{i}") for i, c in enumerate(columns)}
    if "n_chars" in named:
        named["n_chars"] = F.when(F.col("changed"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(named["n_chars"])
    return changed.select(*[F.col(c) if c in ("doc_id", "text") else named[c].alias(c) for c in docs.columns])


def _schema(rows: DataFrame):
    return rows.schema.add("changed", "boolean")


def _with_texts(k: int):
    texts = _texts(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                new = pa.Table.from_batches(list(texts(iter([part])))).column("text").combine_chunks()
                old = part.column("text").cast(new.type)
                same = np.array([a is None or a == b for a, b in zip(old.to_pylist(), new.to_pylist())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), new, part.column("rest"), pa.array(~same)], ["doc_id", "text", "rest", "changed"])

    return run
