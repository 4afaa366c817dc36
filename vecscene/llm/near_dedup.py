"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of five-word shingles: weight = times the shingle occurs x mean inverse document frequency of
its words.  Document frequencies are counted over all documents in a fixed number of hashed word buckets, so the broadcast
table has one size at any scale.  (A shingle's own document frequency would shrink the weight of exactly the shingles that
a large group of copies shares, and so break up the groups looked for.)

Each document gives K consistent samples, R to a band.  Documents that share a band key are candidates, and weighted
Jaccard over the whole texts verifies them.  The shingles of all bucket members are written once; rounds join only the
few sets that they compare.  At first members of a bucket whose components differ only meet one document of its lowest
and highest component, in rounds until one adds no link: that joins large groups by few pairs.  Members of the buckets
that still hold several components then meet by an exact prefix filter on their rarest shingles, so that near misses of
one template, which share buckets but no prefix, are not paired, and no similar pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import PUNCT, Words, chunks, discard, grams, materialize, mix, signed

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 3
#: Hashed word buckets for document frequencies: the broadcast holds this many numbers.
BUCKETS = 1 << 15
#: Candidates that share one copy of their leader's text.
SHARE = 64
#: Members of a prefix bucket that meet all others in the first of these rounds, and the growth from round to round.
LEADERS, GROWTH = 16, 16
#: Rounds over bands go on while at least this share of their pairs is similar.
WORTH = 0.05

_QUANTILES = 1 << 12


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by bisection."""
    u = (np.arange(_QUANTILES) + 0.5) / _QUANTILES
    lo, hi = np.zeros(_QUANTILES), np.full(_QUANTILES, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return lo.astype(np.float32)


_GAMMA = _gamma_table()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, docs = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for part in chunks(batch, "text"):
            w = Words(part.column("text"), PUNCT, fold=True)
            row = np.repeat(np.arange(len(w)), np.diff(w.ptr))
            seen = np.unique(row * BUCKETS + (w.hash % np.uint64(BUCKETS)).astype(np.int64))
            count += np.bincount(seen % BUCKETS, minlength=BUCKETS)
            docs += len(w)
    hit = np.flatnonzero(count)
    yield pa.RecordBatch.from_pydict({"bucket": np.append(hit, -1), "n": np.append(count[hit], docs)})


def word_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each word bucket over all documents."""
    counts = {r[0]: r[1] for r in docs.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()}
    n = counts.pop(-1, 0)
    df = np.zeros(BUCKETS)
    df[list(counts)] = list(counts.values())
    return (1 + np.log((n + 1) / (df + 1))).astype(np.float32)


def weighted_shingles(w: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle hash (each once a row, sorted) and weight.  A text of one to four words is one shingle, of none has none."""
    size = np.diff(w.ptr)
    weight = idf[(w.hash % np.uint64(BUCKETS)).astype(np.int64)]
    starts = w.starts_of(SHINGLE)
    total = np.append(0, np.cumsum(weight, dtype=np.float64))
    row, h = w.row_of(starts), grams(w.hash, SHINGLE, seed=3)[starts]
    mean = (total[starts + SHINGLE] - total[starts]) / SHINGLE
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        whole = np.array([int(mix(grams(w.hash[w.ptr[i] : w.ptr[i + 1]], int(size[i]), seed=4))[0]) for i in short], np.uint64)
        row, h, mean = np.append(row, short), np.append(h, whole), np.append(mean, [(total[w.ptr[i + 1]] - total[w.ptr[i]]) / size[i] for i in short])
    order = np.lexsort((h, row))
    row, h, mean = row[order], h[order], mean[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(row) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(row)))
    return row[first], h[first], mean[first] * times


def samples(h: np.ndarray, log_weight: np.ndarray, begin: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """n consistent weighted samples (hashes of element and level) of each set; sets begin at `begin`."""
    size = np.diff(np.append(begin, len(h)))
    lw = log_weight.astype(np.float32)
    for k in range(n):
        x = mix(h + mix(np.uint64([k + 1]))[0])
        r = _GAMMA[(x >> np.uint64(52)).astype(np.int32)]
        beta = ((x >> np.uint64(40)) & np.uint64(0xFFF)).astype(np.float32) / np.float32(4096)
        u = (((x >> np.uint64(20)) & np.uint64(0xFFFFF)).astype(np.float32) + np.float32(0.5)) * ((x & np.uint64(0xFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-40)
        level = np.floor(lw / r + beta)
        a = np.log(-np.log(u)) - r * (level - beta) - r
        low = np.repeat(np.minimum.reduceat(a, begin), size)
        at = np.flatnonzero(a == low)
        at = at[np.searchsorted(at, begin)]
        yield mix(h[at] ^ mix(level[at].astype(np.int64).view(np.uint64) + np.uint64(k << 32)))


def _signatures(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = idf.value
        for batch in batches:
            for part in chunks(batch, "text", 1 << 19):
                w = Words(part.column("text"), PUNCT, fold=True)
                n = len(w)
                row, h, v = weighted_shingles(w, weight)
                keys = np.zeros((n, BANDS), np.uint64)
                if len(row):
                    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    full = row[begin]
                    each = samples(h, np.log(v), begin, BANDS * ROWS)
                    for b in range(BANDS):
                        key = np.full(len(full), b + 1, np.uint64)
                        for _ in range(ROWS):
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + next(each))
                        keys[full, b] = key
                # the word sequence of each text as two hashes
                place = (np.arange(len(w.hash)) - np.repeat(w.ptr[:-1], np.diff(w.ptr))).astype(np.uint64)
                ends = np.diff(w.ptr).astype(np.uint64)
                same = []
                for s in (1, 2):
                    total = np.append(np.uint64(0), np.cumsum(mix(w.hash + place * np.uint64(0xD6E8FEB86659FD93 + 2 * s) + np.uint64(s)), dtype=np.uint64))
                    same.append(mix(total[w.ptr[1:]] - total[w.ptr[:-1]] + ends))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "same1": signed(same[0]), "same2": signed(same[1]), "filled": ends > 0, "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(signed(keys.ravel())))})

    return run


def _sets(idf):
    """The weighted shingles of each row, sorted by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = idf.value
        for batch in batches:
            for part in chunks(batch, "text", 1 << 19):
                w = Words(part.column("text"), PUNCT, fold=True)
                row, h, v = weighted_shingles(w, weight)
                edge = pa.array(np.searchsorted(row, np.arange(len(w) + 1)), pa.int32())
                yield pa.RecordBatch.from_pydict({"node": part.column("doc_id"), "h": pa.ListArray.from_arrays(edge, pa.array(signed(h))), "v": pa.ListArray.from_arrays(edge, pa.array(v.astype(np.float32)))})

    return run


def _similar(least: float):
    """Rows come sorted by leader and salt, the leader's own first."""

    def jaccard(a, b) -> bool:
        x, y, all_ = a
        at = np.minimum(np.searchsorted(x, b[0]), max(len(x) - 1, 0))
        hit = x[at] == b[0] if len(x) else np.zeros(len(b[0]), bool)
        both = np.minimum(y[at[hit]], b[1][hit]).sum()
        union = all_ + b[2] - both
        return union > 0 and both >= (least - 1e-9) * union

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, lead = None, []
        for batch in batches:
            left, right = [], []
            edge = batch.column("h").offsets.to_numpy()
            edge = (edge - edge[0]).tolist() if len(edge) else []
            h = batch.column("h").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            leaders, others, nodes = (batch.column(c).to_pylist() for c in ("leader", "other", "node"))
            for i, (a, b) in enumerate(zip(edge, edge[1:])):
                own = (h[a:b], v[a:b], v[a:b].sum())
                if not others[i]:
                    if who != leaders[i]:
                        who, lead = leaders[i], []
                    lead.append((own[0].copy(), own[1].copy(), own[2]))
                elif who == leaders[i] and nodes[i] != who and any(jaccard(x, own) for x in lead):
                    left.append(who)
                    right.append(nodes[i])
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (leader, x) whose weighted Jaccard similarity is at least `least`; sets has a row (node, h, v) for each text."""
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SHARE).alias("salts"))
    salted = pairs.join(salts, "leader").select("leader", F.pmod(F.xxhash64("x"), "salts").alias("salt"), "x")
    own = salted.select(F.col("leader").alias("node"), "leader", "salt", F.lit(0).alias("other")).distinct()
    rows = own.unionByName(salted.select(F.col("x").alias("node"), "leader", "salt", F.lit(1).alias("other")))
    met = rows.join(sets, "node").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "other", "node")
    return met.mapInArrow(_similar(least), "a long, b long")


def prefixes(sets: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """band, key, x, before, whole: the shingles of each node's prefix that others have too, the weight before them and of all.

    Shingles are ordered by the number of nodes that hold them, rare ones first.  What comes after the prefix weighs less
    than `least` of the whole, so two sets as similar as that have their first common shingle in both prefixes.
    """
    flat = sets.join(nodes, sets["node"] == nodes["x"], "left_semi").select("node", F.explode(F.arrays_zip("h", "v")).alias("s")).select("node", "s.h", "s.v")
    held = flat.groupBy("h").agg(F.count("*").alias("held"))
    order = Window.partitionBy("node").orderBy("held", "h")
    before = F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("v").over(Window.partitionBy("node"))
    ranked = flat.join(held, "h").withColumn("before", F.coalesce(before, F.lit(0.0))).withColumn("whole", whole)
    return ranked.where((F.col("before") <= (1 - least + 1e-6) * F.col("whole")) & (F.col("held") > 1)).groupBy(F.lit(-1).alias("band"), F.col("h").alias("key"), F.col("node").alias("x")).agg(F.min("before").alias("before"), F.max("whole").alias("whole"))


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) of undirected links a, b: neighbours' minimum, then a jump to the label's label."""
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    at = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        labels = at.select("node", "label")
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = materialize(step.join(jump, "to").select("node", "was", F.least("to", "far").alias("label")))
        discard(at)
        at = new
        if new.where("was <> label").isEmpty():
            discard(both)
            return new


def merged(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """labels (node, label) after links a, b are added; only the components that these join are worked on."""
    if labels is None:
        return components(new)
    fresh = new.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    wider = materialize(labels.select("node", "label").unionByName(fresh.withColumn("label", F.col("node"))))
    for side in ("a", "b"):
        new = new.join(wider.select(F.col("node").alias(side), F.col("label").alias(f"to_{side}")), side)
    roots = components(new.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct())
    moved = wider.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
    out = materialize(moved.select("node", F.coalesce("root", "label").alias("label")))
    discard(labels, wider, roots)
    return out


class _Links:
    """Tested pairs, links found, and the components they make."""

    def __init__(self, verify):
        self.verify, self.tested, self.links, self.labels = verify, [], [], None

    def union(self, tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for x in tables[1:]:
            out = out.unionByName(x)
        return out

    def untested(self, pairs: DataFrame) -> DataFrame:
        """Pairs (leader, x) that met in neither direction so far."""
        if not self.tested:
            return pairs
        known = self.union(self.tested).select(F.least("leader", "x").alias("lo"), F.greatest("leader", "x").alias("hi"))
        return pairs.join(known, (F.least(pairs["leader"], pairs["x"]) == known["lo"]) & (F.greatest(pairs["leader"], pairs["x"]) == known["hi"]), "left_anti")

    def test(self, pairs: DataFrame) -> int:
        """How many of the pairs (a table) are similar."""
        self.tested.append(pairs)
        new = materialize(self.verify(pairs))
        self.links.append(new)
        found = new.count()
        if found or self.labels is None:
            self.labels = merged(self.labels, new)
        return found

    def labelled(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("label", F.col("x"))
        return materialize(rows.join(self.labels, rows["x"] == self.labels["node"], "left").select(*[rows[c] for c in rows.columns], F.coalesce("label", "x").alias("label")))


def linked(members: DataFrame, verify, prefix, least: float = SIMILARITY) -> tuple[DataFrame | None, DataFrame | None]:
    """Links a, b and labels (node, label) of the components of members (band, key, x).

    verify(pairs) gives the similar ones of leader, x; prefix(nodes) the buckets (band, key, x, before, whole) in which all
    similar ones of the nodes x meet.  Any two similar members of a bucket end in one component.
    """
    state = _Links(verify)
    first = True
    while True:
        known = state.labelled(members)
        ends = known.groupBy("band", "key").agg(F.min_by("x", F.struct("label", "x")).alias("low"), F.min("label").alias("low_label"), F.max_by("x", F.struct("label", -F.col("x"))).alias("high"), F.max("label").alias("high_label")).where("low_label < high_label")
        # a bucket of one component has nothing left to link; written apart, so that the join's hot keys can be split
        ends = materialize(ends)
        mixed = materialize(known.join(ends, ["band", "key"]))
        discard(known, ends)
        pairs = mixed.select("x", F.when(F.col("label") == F.col("low_label"), F.col("high")).otherwise(F.col("low")).alias("leader")).where("x <> leader")
        if first:  # first its best leader only
            pairs = pairs.select(F.least("x", "leader").alias("leader"), F.greatest("x", "leader").alias("x")).groupBy("leader", "x").agg(F.count("*").alias("shared"))
            pairs = pairs.groupBy("x").agg(F.max_by("leader", F.struct("shared", -F.col("leader"))).alias("leader"))
        else:
            pairs = state.untested(pairs.distinct())
        pairs = materialize(pairs.select("leader", "x"))
        discard(members)
        members = mixed.select("band", "key", "x")
        members.table_path = mixed.table_path
        n = pairs.count()
        # the first round tests best leaders only; few new links are left to the prefixes
        if not n or not (state.test(pairs) >= WORTH * n or first):
            break
        first = False

    if state.tested:
        rest = materialize(prefix(materialize(members.select("x").distinct())))
        discard(members)
        n = LEADERS
        while True:
            known = state.labelled(rest)
            several = materialize(known.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("held")).where("low < high").select("band", "key", "held"))
            # about n leaders of each bucket by hash, so that no bucket has to be ranked in one task; all once n is its size
            drawn = F.pmod(F.xxhash64("x", "key"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("held") < n
            mixed = materialize(known.join(several, ["band", "key"]).withColumn("leads", drawn).drop("held"))
            discard(known, several, rest)
            if mixed.isEmpty():
                break
            leaders = mixed.where("leads").select(F.col("band").alias("their_band"), F.col("key").alias("their_key"), F.col("x").alias("leader"), F.col("label").alias("own"), F.col("before").alias("their_before"), F.col("whole").alias("their_whole"))
            # both are at most as heavy as what they have from this shingle on, if it is their first common one
            reach = F.least(mixed["whole"] - mixed["before"], F.col("their_whole") - F.col("their_before")) * (1 + least) >= (least - 1e-6) * (mixed["whole"] + F.col("their_whole"))
            pairs = mixed.join(leaders, (mixed["band"] == leaders["their_band"]) & (mixed["key"] == leaders["their_key"]) & ((F.col("leader") < F.col("x")) | ~mixed["leads"]) & (F.col("own") != F.col("label")) & reach).select("leader", "x").distinct()
            pairs = materialize(state.untested(pairs))
            if not pairs.isEmpty():
                state.test(pairs)
            rest = materialize(mixed.where("not leads").drop("leads", "label"))
            discard(mixed)
            n *= GROWTH
    discard(*state.tested)
    return (state.union(state.links) if state.links else None), state.labels


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), n_links (verified links of its distinct text): a row for each input row.

    Texts with equal word sequences (case and ASCII punctuation aside) share a class from the start, wordless, empty and
    null texts among them.  Rows with a null doc_id get a null class.  Rows of one doc_id are one document, with any of
    whose texts others may be linked.  An empty table gives none; other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    idf = spark.sparkContext.broadcast(word_weights(docs))
    signs = materialize(docs.mapInArrow(_signatures(idf), "doc_id long, same1 long, same2 long, filled boolean, bands array<long>"))
    groups = materialize(signs.where("doc_id is not null").groupBy("same1", "same2").agg(F.min("doc_id").alias("rep")))
    placed = materialize(signs.join(groups, ["same1", "same2"], "left").select("doc_id", "rep"))
    # one row of each group of equal texts speaks for it, so the join's rows follow the groups and not their sizes
    own = signs.where("filled").join(groups.withColumnRenamed("rep", "doc_id"), ["doc_id", "same1", "same2"]).select(F.col("doc_id").alias("x"), F.posexplode("bands").alias("band", "key")).distinct()
    own = materialize(own)
    discard(signs, groups)
    sizes = materialize(own.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    members = materialize(own.join(sizes, ["band", "key"]))
    discard(own, sizes)

    # the texts are read once more here, those of bucket members only; all rounds work on their shingles
    ids = members.select(F.col("x").alias("doc_id")).distinct()
    sets = materialize(docs.join(ids, "doc_id").mapInArrow(_sets(idf), "node long, h array<long>, v array<float>"))
    links, labels = linked(members, lambda pairs: _verified(pairs, sets, least), lambda nodes: prefixes(sets, nodes, least), least)
    discard(sets)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
        labels = spark.createDataFrame([], "node long, label long")
    degree = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct().groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    final = labels.join(degree, "node").select("node", "label", "n_links")
    reps = placed.select("rep").distinct().join(final, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    reps = materialize(reps.where("rep is not null"))
    return placed.join(reps, "rep", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.col("n_links")).alias("n_links"))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows whose doc_id is the smallest of its class; rows with a null doc_id stay."""
    gone = classes(docs, least).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
