import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from vecscene.llm import bpe, decontaminate, html_extract, licenses, near_dedup, quality, queries, shards, substring_dedup, token_counts, url_filter
from vecscene.llm.common import PUNCT, Words

PATH = queries.VOCABULARY
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor string, label int, rid int, host string"


def _rows():
    random.seed(5)
    vocab = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 9))) for _ in range(300)]
    say = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    base, shared = say(120), say(60)
    texts = [None, "", "  \n\t ", "one", base, base, base + " tail", "x " + base, base.replace(" ", "\n", 3), say(30) + " " + shared + "\n" + say(20), shared, say(15) + " " + shared, "ab " * 300, say(5000), "Released under the MIT License.\n" + say(40), "Licensed under CC BY-NC 4.0. " + say(10), "it's  'LL we'll\n\n #$% | 12٣ 漢字 😀", "License MIT license, Apache-LICENSE general public license"]
    texts += [f"common line here\n{say(30)}" for _ in range(60)]
    return [(i, t, "en", None if i == 3 else "src0", len(t or ""), "c", 1, 2, "h") for i, t in enumerate(texts)] + [(len(texts), "dup row", "en", "s", 7, "c", 1, 2, "h")] * 2


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def null_id(spark, rows):
    return spark.createDataFrame([(None, "some text here", None, None, None, None, None, None, None)], SCHEMA)


words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_empty_tables_and_null_ids(empty, null_id, spark):
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    edits = queries.edits_of
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for f in (near_dedup.classes, shards.assign, lambda d: token_counts.count_edited(d, edits(d), PATH), licenses.scan, lambda d: decontaminate.leaks(d, bench), lambda d: bpe.encode_digest(d, PATH), substring_dedup.dedup_digest, quality.quality_digest):
        assert f(empty).count() == 0
        f(null_id).collect()
    assert url_filter.judge(pages).count() == 0 and html_extract.extract(pages).count() == 0
    assert decontaminate.leaks(null_id, bench.limit(0)).count() == 0


def test_near_dedup_finds_all_pairs(docs, rows):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    ids = [r[0] for r in rows]
    w = Words(pa.array([r[1] for r in rows], pa.string()), PUNCT, fold=True)
    row, h, v = near_dedup.weighted_shingles(w, near_dedup.word_weights(docs))
    sets = collections.defaultdict(dict)
    for a, b, c in zip(row, h, v):
        sets[a][b] = c
    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = sum(min(a[x], b[x]) for x in a.keys() & b.keys())
            if both and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                assert got[ids[i]] == got[ids[j]]
    assert got[0] == got[1] == got[2] == 0 and got[4] == got[5] == got[6] == 4 and got[9] == 9
    kept = {r["doc_id"] for r in near_dedup.keep_one(docs).collect()}
    assert kept == set(got.values())


def similar_pairs(docs, least=0.8):
    """All pairs of doc_ids of a small table whose weighted Jaccard similarity is `least` or more, over postings of every shingle."""
    idf = near_dedup.word_weights(docs)
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    row, h, v = near_dedup.weighted_shingles(Words(pa.array([r["text"] for r in rows], pa.string()), PUNCT, fold=True), idf)
    v = v.astype(np.float64)
    whole = np.bincount(row, v, minlength=len(rows))
    order = np.argsort(h, kind="stable")
    of, weight, begin = row[order], v[order], np.searchsorted(h[order], h)
    count = np.searchsorted(h[order], h, side="right") - begin
    edge, out = np.searchsorted(row, np.arange(len(rows) + 1)), []
    for i in range(len(rows)):
        a, b = edge[i], edge[i + 1]
        n = count[a:b]
        at = np.repeat(begin[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(of[at], np.minimum(weight[at], np.repeat(v[a:b], n)), minlength=i + 1)[:i]
        hit = np.flatnonzero((both > 0) & (both >= least * (whole[i] + whole[:i] - both)))
        out += [(rows[j]["doc_id"], rows[i]["doc_id"]) for j in hit]
    return out


def test_recall_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    pairs = similar_pairs(docs)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    print(f"{found} of {len(pairs)} pairs in one class")
    assert len(pairs) > 1000 and found >= 0.9 * len(pairs)


def test_all_components_of_a_bucket_meet(spark):
    random.seed(6)
    # A, B, D, E, H in one bucket, with D ~ E; then B ~ D where A is B's component's first; then many buckets by chance
    buckets = [[1, 2, 3, 4, 5], [11, 12, 13, 14, 15], *(random.sample(range(100, 160), 25) for _ in range(4))]
    shared = {(a, b) for bucket in buckets for a in bucket for b in bucket if a < b}
    similar = {(1, 2), (3, 4), (11, 12), (12, 13)} | set(random.sample(sorted(x for x in shared if x[0] >= 100), 40))
    members = spark.createDataFrame([(0, k, x) for k, bucket in enumerate(buckets) for x in bucket], "band int, key long, x long")
    truth = spark.createDataFrame([p for a, b in similar for p in ((a, b), (b, a))], "leader long, x long")
    _, labels = near_dedup.linked(members, lambda pairs: pairs.join(truth, ["leader", "x"]).select(F.col("leader").alias("a"), F.col("x").alias("b")), lambda nodes: members.withColumns({"before": F.lit(0.0), "whole": F.lit(1.0)}))
    got = {r["node"]: r["label"] for r in labels.collect()}
    want = {x: x for bucket in buckets for x in bucket}
    for _ in want:
        for a, b in similar:
            want[a] = want[b] = min(want[a], want[b])
    assert all(got.get(x, x) == label for x, label in want.items())


def test_samples_agree_with_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = rng.uniform(0.5, 3, 400), rng.uniform(0.5, 3, 400)
    n = 1500
    same = sum(int(x[0] == x[1]) for x in near_dedup.samples(np.concatenate([h, h]), np.log(np.concatenate([a, b])), np.array([0, 400]), n))
    assert abs(same / n - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_shards(docs, rows, spark):
    got = shards.assign(docs, 7).collect()
    assert len(got) == len(rows)
    per = collections.defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1 and all(sorted(x) == list(range(len(x))) for x in per.values())
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in got)
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    sizes = [r["count"] for r in shards.assign(hot, 40).groupBy("shard").count().collect()]
    assert len(sizes) == 40 and set(sizes) == {75}


@pytest.mark.parametrize("linked", [0.1, 0.5, 1.0])
def test_few_groups_are_cut(spark, monkeypatch, linked):
    """Against the best layout: groups of four fit whole into shards of 100 rows, all of them."""
    monkeypatch.setattr(shards, "BLOCK", 64)  # more rows than BLOCK for each shard
    n = 2000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < int(n * linked), F.concat(F.lit("g"), F.floor(F.col("id") / 4))).otherwise(F.concat(F.lit("x"), "id")).alias("text"))
    out = shards.assign(rows, 20)
    assert {r["count"] for r in out.groupBy("shard").count().collect()} == {100}
    links, cut = shards.cut_links(out).first()
    assert links == n * linked and cut <= 2 * 20


def test_large_groups_and_repeated_rows(spark):
    rows = [(i, "hot") for i in range(700)] + [(i, None) for i in range(700, 900)] + [(5, "same row")] * 60 + [(1000 + i, f"t{i}") for i in range(40)]
    out = shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    assert out.count() == 1000 and {r["count"] for r in out.groupBy("shard").count().collect()} == {100}
    where = collections.Counter((r["text_crc32"], r["shard"]) for r in out.collect())
    assert len([1 for (crc, _) in where if crc == zlib.crc32(b"hot")]) <= 10
    assert len([1 for (crc, _) in where if crc == zlib.crc32(b"same row")]) == 1


def test_propagation_mends_links(spark):
    """Parts of one group that start apart come together where there is room; moves out of a full shard lower its load."""
    parts = spark.createDataFrame([(g, g, p, False, 5, (g + p) % 4) for g in range(6) for p in range(2)] + [(100 + i, 0, 0, True, 10, 0) for i in range(10)], "g1 long, g2 long, part long, alone boolean, n long, shard int")
    kept, history = shards.propagate(parts, [40, 40, 40, 40])
    assert sum(history[0]) > 0 and min(map(sum, history)) < sum(history[0]) / 2
    assert kept.agg(F.sum("n")).first()[0] == 160


def _pattern():
    import regex

    return regex.compile(P.PATTERN)


def test_token_counts(docs, rows):
    vocab = bpe.Vocabulary(open(PATH, "rb").read())
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    got = {r["doc_id"]: r for r in token_counts.count_edited(docs, queries.edits_of(docs), PATH).collect()}
    for i, text, lang, source, *_ in rows:
        t, source = text or "", source or ""
        n = len(t)
        for start, deleted, inserted in ((0, 0, f"{source}: "), (n // 2, 3, f" it's 2024, {lang}"), (n * 2 // 3, 12, ""), (n + 1_000_000, 0, f"\n\nEnd of {source}")):
            start = min(start, len(t))
            t = t[:start] + inserted + t[start + deleted :]
        assert (got[i]["n_tokens_before"], got[i]["n_tokens"]) == (len(enc.encode_ordinary(text or "")), len(enc.encode_ordinary(t)))
    assert got[13]["n_reencoded"] < 60 < got[13]["n_pretokens"] and {r["n_edits"] for r in got.values()} == {4}


def test_kept_trees_take_more_edits(spark, tmp_path):
    """Trees are written, read and edited twice; the counts are those of the whole text, the work is not."""
    vocab = bpe.Vocabulary(open(PATH, "rb").read())
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    texts = ["some words it's here " * 400, "", "é" * 50 + "\n\n x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_counts.build(docs, PATH).write.parquet(str(tmp_path / "0"))
    for k, ops in enumerate([[(0, 5, 2, "ab'll"), (0, 5, 2, "ab'll"), (1, None, None, "Start ")], [(0, 4000, 100, ""), (0, 4000, 100, "later in order"), (None, 10**9, 1, " end")]]):
        edits = spark.createDataFrame([(i, *e) for i in range(3) for e in ops], "doc_id long, seq long, start long, n_deleted long, inserted string")
        token_counts.update(spark.read.parquet(str(tmp_path / str(k))), edits, PATH).write.parquet(str(tmp_path / str(k + 1)))
        for e in sorted({(q or 0, s or 0, n or 0, x or "") for q, s, n, x in ops}):
            for i, t in enumerate(texts):
                at = min(e[1], len(t))
                texts[i] = t[:at] + e[3] + t[at + e[2] :]
        got = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / str(k + 1))).collect()}
        for i, t in enumerate(texts):
            ids = enc.encode_ordinary(t)
            assert got[i]["text"] == t and got[i]["n_tokens"] == len(ids) == sum(got[i]["tokens"]) and sum(got[i]["widths"]) == len(t)
        assert got[0]["n_reencoded"] < 60 < got[0]["n_pretokens"]


def test_random_edits():
    vocab = bpe.Vocabulary(open(PATH, "rb").read())
    count = lambda p: len(vocab.ids([p.encode()])[0])
    pattern = _pattern()
    random.seed(3)
    parts = ["'", "'s", "re", "l", " ", "  ", "\n", "a", "é", "12", "!"]
    some = lambda n: "".join(random.choice(parts) for _ in range(random.randint(0, n)))
    for _ in range(300):
        t = some(60)
        pieces = [m.group() for m in pattern.finditer(t)]
        tree = token_counts.CountTree(t, np.append(0, np.cumsum([len(x) for x in pieces])).astype(int), np.array([count(x) for x in pieces], np.int64), count)
        for _ in range(5):
            start, deleted, inserted = random.randint(0, len(t)), random.choice([0, 0, 1, 3, 10]), some(4)
            tree.edit(start, deleted, inserted)
            t = t[:start] + inserted + t[start + deleted :]
            want = [m.group() for m in pattern.finditer(t)]
            assert tree.pieces() == want and tree.total == sum(map(count, want))


def test_licenses(docs, rows):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, text, *_ in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
        places = sorted((k, label) for label, p in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
    assert got[14]["labels"] == "mit" and (got[15]["labels"], got[15]["base_labels"]) == ("cc", "") and got[17]["labels"] == "apache,gpl,mit"


def test_wrapped_and_scattered_licenses(spark):
    bsd, mpl, mit = (licenses.TEMPLATES[x][-1 if x != "mit" else 1] for x in ("bsd", "mpl", "mit"))
    wrap = lambda t, n, mark="": "\n".join(mark + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    filler = "lorem ipsum dolor sit amet consectetur " * 20
    texts = [filler + "\n" + wrap(bsd, 10, " * ") + ":\n" + filler, wrap(mpl, 12), wrap(mit, 13, "# "), filler.join(bsd.split()), filler + bsd + " " + filler]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("bsd", 1.0), 1: ("mpl", 1.0), 2: ("mit", 1.0), 3: ("", 0.0), 4: ("bsd", 1.0)}


def test_urls(spark):
    urls = ["http://www.EXAMPLE.com/en/a?x", "https://example.com/en/1", "https://a.b.net/fr/#t", "https://a.b.net/de/", "https://q.org", None, "nothing", "x://h.com/#", "https://netx/es/", "ftp://net/es/?", "https://www.example.com/EN/"]
    html = ["<a href='https://good.org/x'>"] + ["<a href=\"https://a.b.net/\">"] * 3 + ["<p>"] * 7
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(zip(urls, html))], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert [got[i]["rule"] for i in range(11)] == ["www.example.com/en/", "example.com/en/", "net/fr/", None, None, None, None, "com/", None, "net/es/", "com/"]
    assert (got[0]["host"], got[0]["path"], got[5]["host"], got[6]["path"], got[7]["path"]) == ("www.example.com", "/en/a", "", "", "/")
    assert {got[i]["verdict"] for i in (4, 5, 6)} == {"allow"} and {got[i]["verdict"] for i in (1, 2, 9)} == {"block"}


def test_links_and_distrust(spark):
    """Links of any scheme or none count, and who links to blocked hosts alone is blocked."""
    link = lambda *urls: "".join(f"<a class=x href='{u}'>" for u in urls)
    pages = [("http://bad.net/fr/", link()), ("http://ring.org/a", link("//bad.net/fr/", "FTP://Bad.net/x", "/local", "mailto:x@y.z")), ("http://fan.org/", link("//ring.org/")), ("http://good.com/", link("https://nice.org/?q")), ("http://nice.org/", link()), ("http://a.co.uk/", link("//bad.net")), ("http://b.co.uk/", link()), ("http://m.nice.org/", None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    edges = {(r["source"], r["target"]): r["n"] for r in url_filter.host_edges(df).collect()}
    assert edges == {("ring.org", "bad.net"): 2, ("fan.org", "ring.org"): 1, ("good.com", "nice.org"): 1, ("a.co.uk", "bad.net"): 1, ("m.nice.org", "nice.org"): 1, ("nice.org", "m.nice.org"): 1}
    got = {r["host"]: r["verdict"] for r in url_filter.judge(df).collect()}
    assert got == {"bad.net": "block", "ring.org": "block", "fan.org": "block", "good.com": "allow", "nice.org": "allow", "a.co.uk": "block", "b.co.uk": "allow", "m.nice.org": "allow"}


def test_host_scores(spark):
    random.seed(2)
    names = [f"h{i}" for i in range(8)]
    n = {(a, b): random.randint(1, 4) for a in names for b in names if a != b and random.random() < 0.4}
    seeds = {"h0": (0.5, 0.0), "h1": (0.5, 0.25), "h2": (0.0, 0.75), "lone": (0.0, 0.0)}
    edges = spark.createDataFrame([(a, b, c) for (a, b), c in n.items()], "source string, target string, n long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.host_scores(edges, spark.createDataFrame([(h, *x) for h, x in seeds.items()], "host string, good double, bad double")).collect()}
    out, into = collections.Counter(), collections.Counter()
    for (a, b), c in n.items():
        out[a] += c
        into[b] += c
    hosts = names + ["lone"]
    t, d = ({h: seeds.get(h, (0.0, 0.0))[k] for h in hosts} for k in (0, 1))
    for _ in range(200):
        t, d = (
            {h: 0.15 * seeds.get(h, (0.0, 0.0))[0] + 0.85 * sum(t[a] * c / out[a] for (a, b), c in n.items() if b == h) for h in hosts},
            {h: 0.15 * seeds.get(h, (0.0, 0.0))[1] + 0.85 * sum(d[b] * c / into[b] for (a, b), c in n.items() if a == h) for h in hosts},
        )
    assert all(abs(got[h][0] - t[h]) < 1e-5 and abs(got[h][1] - d[h]) < 1e-5 for h in got)


def test_myers_and_leaks(spark):
    random.seed(0)

    def distance(p, t):
        prev = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            cur = [i]
            for j, y in enumerate(t, 1):
                cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
            prev = cur
        return min(prev)

    for _ in range(200):
        p, t = ([random.randint(0, 3) for _ in range(random.randint(1, 20))] for _ in range(2))
        assert decontaminate.myers(p, t)[0] == distance(p, t)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(random.choice(vocab) for _ in range(random.choice([3, 12, 25, 60])))) for i in range(12)] + [(99, None), (98, " , ")]
    docs = []
    for i in range(60):
        w = [random.choice(vocab) for _ in range(random.randint(0, 80))]
        if i % 2:
            x = random.choice(items[:12])[1].split()
            for _ in range(random.randint(0, 8)):
                x[random.randrange(len(x))] = "zz"
            w[len(w) // 2 : len(w) // 2] = x
        docs.append((i, " ".join(w)))
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k): d for i, t in docs for k, x in items[:12] if (d := distance(x.split(), t.split())) <= decontaminate.budget(len(x.split()))}
    assert got == want


def test_leaks_of_repeated_rows_and_columns(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " + item, 7), (1, "x " + item, 7), (1, "other", 7), (2, "long " * 50_000 + item, 7), (None, item, 7), (3, "", 7), (4, None, 7)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(5, item, "t"), (5, item, "t"), (6, "", "t")], "item_id long, text string, doc_id string")
    got = sorted(((r["doc_id"] or 0, r["item_id"], r["n_edits"], r["last_word"]) for r in decontaminate.leaks(docs, items).collect()))
    assert got == [(0, 5, 0, 19), (1, 5, 0, 20), (1, 5, 0, 20), (2, 5, 0, 50_019)]
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()} == {None, 3, 4}


def test_bpe_matches_tiktoken(docs, rows):
    vocab = bpe.Vocabulary(open(PATH, "rb").read())
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_digest(docs, PATH).collect()}
    for i, text, *_ in rows:
        ids = enc.encode_ordinary(text or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert all(back[i] == (t or "").encode() for i, t, *_ in rows)


def test_random_pretokens():
    random.seed(1)
    parts = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "é", "Zb", "12", "٣", "!", "$%", "漢", "😀", "t", "l", "\u0085", "x" * 40, "a" * 500]
    vocab = bpe.Vocabulary(open(PATH, "rb").read())
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(1500)]
    for t, (ids, _) in zip(texts, bpe.encode_rows(pa.RecordBatch.from_pydict({"text": texts}), vocab)):
        assert ids.tolist() == enc.encode_ordinary(t)


def test_substring_dedup(docs, rows):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    got = {r["doc_id"]: r for r in substring_dedup.dedup_digest(docs).collect()}
    texts = {r["doc_id"]: r for r in substring_dedup.dedup_documents(docs).collect()}
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone) if not g]
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        assert words(texts[i]["text"]) == kept and (any(gone) or texts[i]["text"] == t) and texts[i]["host"] == "h"


def _removals(rows, k=13):
    """Kept words of each row, by brute force."""
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup_of_repeated_ids_and_branches(spark):
    random.seed(12)
    say = lambda n, of=10**6: " ".join(f"w{random.randint(0, of)}" for _ in range(n))
    w, q = say(90), say(70)
    rows = [(1, w), (5, "z"), (9, say(90)), (5, q + " " + w), (5, q + " " + w), (7, q), (8, "a b " * 300), (6, "a b " * 40), (5, None), (10, say(4000, 6)), (11, say(4000, 6))]
    parts = [say(n) for n in (20, 25, 30, 14)]
    for i in range(30):  # passages that meet in many orders
        rows.append((20 + i, " ".join(random.choice(parts) for _ in range(6)) + " " + say(3)))
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        got = sorted(tuple(r) for r in substring_dedup.dedup_digest(df.select("doc_id", "text")).collect())
        assert got == _removals(order)


def test_paths_are_compacted_and_verified(spark):
    """A long passage in two documents is one span, and a span whose digest differs removes nothing."""
    random.seed(13)
    say = lambda n: " ".join(f"w{random.randint(0, 10**6)}" for _ in range(n))
    shared = say(400)
    df = spark.createDataFrame([(1, say(5) + " " + shared), (2, shared + " " + say(5)), (3, say(50))], "doc_id long, text string")
    marks = substring_dedup.removals(df).collect()
    assert [r["doc_id"] for r in marks] == [2] and len(marks[0]["gone"]) <= 3 and sum(g["n"] for g in marks[0]["gone"]) + len(marks[0]["gone_edges"] or []) >= 388
    spans = [{"first": 0, "n": 4, "digest": b"no"}, {"first": 30, "n": 9, "digest": b"no"}]
    part = pa.RecordBatch.from_pydict({"text": [say(30)], "gone": [spans], "gone_edges": [[25]]})
    assert not substring_dedup._cover(part, 13)[1].any()


def test_containment_against_every_window(spark):
    """Random texts of template tokens and others, long ones too: each window of each template counted by itself."""
    import math

    random.seed(31)
    templates = {"a": ["one two three four five six", "seven eight nine"], "b": ["one three five seven nine eleven one three"]}
    vocab = "one two three four five six seven eight nine eleven".split() + ["x", "y", "z", "é"]
    texts = [None, "", "...", *[random.choice(["", "- "]) + " ".join(random.choice(vocab) for _ in range(random.randint(1, 30))) + random.choice(["", "."]) for _ in range(200)]]
    texts += [" ".join(random.choice(vocab[8:]) for _ in range(20_000)) + " One, TWO\nthree four five", " ".join(["one two three"] * 3000)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(7, texts[7], "k")], "doc_id long, text string, label string")
    want = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
        for label, all_ in templates.items():
            for x in all_:
                tokens, span = set(x.split()), math.ceil(licenses.SPAN * len(x.split()))
                most = max((len(tokens & set(w[k : k + span])) for k in range(len(w))), default=0)
                if most >= math.ceil(0.8 * len(tokens) - 1e-9):
                    want[i, label] = max(want.get((i, label), 0), most / len(tokens))
    got = {(r["doc_id"], r["label"]): r["score"] for r in licenses.contained(docs, templates).collect()}
    assert got == want and len(want) > 20


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>Menu</ul></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p><b>One<br>two\n three<p>Four &lt;5<div class='comments'>me too</div><ul><li>x<li>y</ul></article><aside>s</aside><footer>&copy; f</footer>"
    plain = "<body><div id=main><p>Own %d</p><div>Same on all</div></div></body>"
    rows = [(0, "http://a.b/", page, 1), (1, None, None, 1)] + [(10 + i, f"http://site.c/{i}", plain % i, 1) for i in range(8)]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, path int")).collect()}
    assert got[0]["text"] == "A & B\n\nOne two three\n\nFour <5\n\nx\n\ny" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == "" and all(got[10 + i]["text"] == f"Own {i}" for i in range(8))


def test_html_of_copies_and_compound_names(spark):
    copies = [(i, "http://mirror.a/%d" % i, "<html><body><article><h1>Title %d</h1><p>Text %d of it</p></article></body></html>" % (i % 2, i % 2)) for i in range(20)]
    names = ("layout has-sidebar", "no-sidebar", "article-header", "related-work")
    compound = [(100 + i, f"http://b{i}.c/", f"<body><div class='{x}'><article><p>Kept</p><div class='cookie-banner'>no</div><article class='related'>nor this</article></article></div></body>") for i, x in enumerate(names)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(copies + compound, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i % 2}\n\nText {i % 2} of it" for i in range(20)) and all(got[100 + i] == "Kept" for i in range(4))


def test_malformed_and_deep_pages(spark):
    import time

    deep = "<div>" * 20_000 + "x" + "</div></q>" * 20_000
    pages = ["<![foo[y]]><p>after", "<![CDATA[a>b]]> c", "<!weird <p>x", "<a <b <c>text</c", "</p></div>tail &bogus; &#xD800; &amp", "\0<p>nul", "<article><div class='post-header'><h1>Head</h1></div><p>Body</article>", "<div><p>" + "Long body here. " * 20 + "</p><article class=teaser>Buy</article></div>", deep, "<p>a<hr>b<br>c", None, "", "<script>never closed", "<!-- open"]
    rows = [(i, f"http://h{i}.a/", h, "s") for i, h in enumerate(pages)] + [(0, "http://h0.a/", pages[0], "s")]
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()]
    assert len(got) == len(rows) and got.count((0, "after")) == 2
    text = dict(got)
    assert (text[6], text[8], text[9], text[10], text[11], text[12]) == ("Head\n\nBody", "x", "a\n\nb c", "", "", "") and text[7].startswith("Long body")
    took = []
    for n in (2000, 8000):
        began = time.perf_counter()
        html_extract.blocks_of("<div>x" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def _tree(pages, prior):
    """The kept text of each page by the definition of the tree, in plain loops; pages are (host, html)."""
    import math

    parsed = [(host, html_extract._row(h, prior)) for host, h in pages]
    distinct = {(host, same): (blocks, leaves, styles) for host, (same, blocks, leaves, styles) in parsed}
    everyone = {host for host, _ in distinct} | {html_extract.ALL}

    def importances(host):
        own = [x for (h, _), x in distinct.items() if host in (h, html_extract.ALL)]
        m, n, ways, under = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
        for blocks, leaves, styles in own:
            m.update({x for e in leaves for x in e["up"]})
            n.update({(b["node"], b["content"]) for b in blocks if b["text"] is not None})
            ways.update({(x["node"], x["style"]) for x in styles})
            for e in leaves:
                for x in e["up"]:
                    under[x].add(e["node"])
        size, linked = collections.Counter(), collections.Counter()
        for h, (_, blocks, _, _) in parsed:
            for b in (b for b in blocks if b["text"] is not None) if host in (h, html_extract.ALL) else ():
                size[b["node"]] += b["size"]
                linked[b["node"]] += b["linked"]
        content = {c: 1 - math.log(k) / math.log(m[c[0]]) if m[c[0]] > 1 else 1.0 for c, k in n.items()}
        branch = {}
        for x in (x for x in m if any(c[0] in under[x] for c in n)):
            inner = sum(k * content[c] for c, k in n.items() if c[0] in under[x]) / sum(k for c, k in n.items() if c[0] in under[x])
            shown = [k for (node, _), k in ways.items() if node == x]
            shape = min(1.0, -sum(k / sum(shown) * math.log(k / sum(shown)) for k in shown) / math.log(m[x])) if m[x] > 1 else 1.0
            g = html_extract.DAMPING ** len(shown)
            branch[x] = ((1 - g) * shape + g * inner) * (1 - sum(linked[y] for y in under[x]) / sum(size[y] for y in under[x]))
        return m, content, branch

    known = {host: importances(host) for host in everyone}
    _, all_contents, all_branches = known[html_extract.ALL]
    out = []
    for host, (_, blocks, leaves, _) in parsed:
        m, content, branch = known[host]
        mean = lambda k, own, all_: ((k - 1) * own + html_extract.SHARED * all_) / (k - 1 + html_extract.SHARED)
        gone = {e["node"] for e in leaves if min((mean(m[x], branch[x], all_branches[x]) for x in e["up"] if x in branch), default=1) * (prior if e["noise"] else 1) < html_extract.MIN_IMPORTANCE}
        kept = [b["text"] for b in blocks if b["text"] is not None and b["node"] not in gone and mean(m[b["node"]], content[b["node"], b["content"]], all_contents[b["node"], b["content"]]) >= html_extract.MIN_IMPORTANCE]
        out.append("\n\n".join(t for t in kept if t is not None))
    return out


def test_texts_are_those_of_the_tree(spark):
    """Against plain loops over pages of large and small hosts, with the names and without them."""
    random.seed(21)
    say = lambda n: " ".join(random.choice("abcdefghijkl") * random.randint(1, 4) for _ in range(n))
    pages = []
    for host, size in (("big.a", 30), ("mid.b", 9), ("two.c", 2), ("one.d", 1)):
        top, side = say(3), say(8)
        for i in range(size):
            menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in say(5).split())
            body = "".join(f"<p>{say(random.randint(4, 20))}</p>" for _ in range(random.randint(1, 6)))
            comments = "".join(f"<div class=comment><p>{say(4)}</p></div>" for _ in range(i % 3))
            pages.append((host, f"<div class=brand>{top}</div><div class=links><ul>{menu}</ul></div><div class=ad>{say(5)}</div><main><h1>{say(4)}</h1>{body}<p>See <a href=x>{say(1)}</a></p><p>Share this</p></main><div class=box><p>{side}</p></div>{comments}<footer>{host} {say(2)}</footer>"))
    pages.append(pages[3])
    df = spark.createDataFrame([(i, f"http://{host}/{i}", h, "n") for i, (host, h) in enumerate(pages)], "page_id long, url string, html string, node string").repartition(3)
    for prior in (html_extract.PRIOR, 1.0):
        got = [r["text"] for r in html_extract.extract(df, prior).orderBy("page_id").collect()]
        assert got == _tree(pages, prior)
        for (host, h), text in zip(pages[:39], got):
            assert re.search(r"<h1>(.*?)</h1>", h)[1] in text and "Share this" not in text  # said on every page
            assert re.search(r"class=brand>(.*?)<", h)[1] not in text.split("\n\n")
            first = re.search(r"class=links><ul><li><a href='/(.*?)'", h)[1]
            assert text.split("\n\n")[0] != first  # a menu of links, named as one or not
            assert (re.search(r"class=ad>(.*?)<", h)[1] in text) == (prior == 1.0)


def test_styles_that_hosts_share_judge_small_ones(spark):
    """A line that all hosts have in one place goes from hosts of one page too; a line of two pages of one host stays."""
    page = "<div class=post><p>%s</p></div><div class=made><span>Made with Something</span></div>"
    pages = [(i, f"http://h{i}.x/", page % f"Own text {i}") for i in range(40)] + [(100 + i, "http://pair.y/", page % "Both say this") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own text {i}" for i in range(40)) and got[100] == got[101] == "Both say this"


def test_quality(docs, rows):
    got = {r["doc_id"]: r for r in quality.quality_digest(docs).collect()}
    for i, text, *_ in rows:
        t = text or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        c = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        g = [0] * len(w)
        for j in range(len(w) - 7):
            if c[tuple(w[j : j + 8])] > 1:
                g[j : j + 8] = [1] * 8
        failed = len(w) < 20 or 100 * sum(g) > 30 * len(w)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(g), failed)
        assert r["kept"] == (not failed)
    assert got[30]["n_removed_chars"] == len("common line here")
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {i for i, r in got.items() if r["kept"]}


def test_documents_of_common_lines_go(spark):
    random.seed(8)
    say = lambda n: " ".join(f"w{random.randint(0, 10**6)}" for _ in range(n))
    common = say(40)
    texts = [f"{common}\n{say(2)}" for _ in range(30)] + [say(40) for _ in range(270)]  # 10 % of the host
    out = quality.keep_good(spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in out.collect()} == set(range(30, 300))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_rejected_rows_of_a_kept_text_go(spark):
    """One doc_id and text under two sources: common lines of one source reject there, and there only."""
    line = "the same long line of boilerplate stands here on every page of this source again and again"
    texts = [f"{line} \n{i} " + " ".join(f"w{i}x{j}" for j in range(3)) for i in range(quality.MAX_DOCS + 2)]
    docs = spark.createDataFrame([(i, t, "A") for i, t in enumerate(texts)] + [(5, texts[5], "B"), (5, texts[5], None), (5, texts[5], "B")], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["source"] or "") for r in quality.keep_good(docs).collect()) == [(5, ""), (5, "B"), (5, "B")]


@pytest.mark.parametrize("m", [3, 6, 7, 8, 9, 13, 14, 19, 20, 40])
def test_every_item_has_its_budget(spark, m):
    """Each length: found with as many edits as the rate allows wherever they fall, not with one more."""
    random.seed(m)
    item = [f"item{m}word{i}" for i in range(m)]
    e = int(decontaminate.RATE * m)
    texts = []
    for n in (e, e + 1):
        for _ in range(4):
            x = list(item)
            for i in random.sample(range(m), n):
                x[i] = "changed"
            texts.append((n, "some words before " + " ".join(x) + " and some after"))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()} == {i for i, (n, _) in enumerate(texts) if n <= e}


def test_owned_tables_go(spark):
    from vecscene.llm import common

    with common.owned() as keep:
        a, b = (common.materialize(spark.range(n)) for n in (3, 4))
        keep.append(b)
    assert b.count() == 4
    with pytest.raises(Exception):
        a.count()


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on planted cases: what it takes out, and what it leaves."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    random.seed(14)
    say = lambda n: " ".join(f"v{random.randint(0, 10**6)}" for _ in range(n))
    clean = {i: say(60) for i in range(10)}
    item, shared = say(30), say(55)
    near = clean[3].split()
    near[50] = "changed"
    docs = {**clean, 20: "too short", 21: "x y " * 60, 30: clean[3], 31: " ".join(near), 40: say(40) + " " + shared, 41: say(45) + " " + shared + " " + say(5), 50: say(40) + " " + item + " " + say(30)}
    rows = [(i, t, "en", "src", len(t)) for i, t in docs.items()] + [(60, None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*clean, 40, 41}
    kept = {i: t for i, t in docs.items() if i in got}
    kept[41] = " ".join(w for w in docs[41].split() if w not in set(shared.split()))
    for i, t in kept.items():
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, sf)
    assert len([x for x in set(os.listdir(folder)) - before if x.startswith("table-")]) == 1  # what the result reads
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf)
        assert step.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in step.collect()} and out.count() < docs.count()


def test_blocks_that_the_prior_settles_are_not_kept(spark):
    """They go from every page, so the parsed table holds nothing of them; with a prior of 1 all are kept."""
    html = "<body><nav><p>Home</p><p>About</p></nav><article><p>One two.</p></article><footer>End</footer></body>"
    pages = spark.createDataFrame([(1, "http://a.com/", html)], "page_id long, url string, html string")
    texts = lambda *prior: [b["text"] for b in html_extract.parse(pages, *prior).first()["blocks"]]
    assert texts() == ["One two."] and texts(1.0) == ["Home", "About", "One two.", "End"]
