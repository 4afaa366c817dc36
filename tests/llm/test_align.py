import collections
import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecscene.llm import align, queries

A, B = queries.BYTES, queries.PIECES


@pytest.fixture(scope="module")
def coders():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = align._unmapped()
    of_a = lambda i: bytes(byte[c] for c in t.id_to_token(i))
    of_b = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    return lambda x: [(i, of_a(i)) for i in t.encode(" " + x, add_special_tokens=False).ids], lambda x: [(i, of_b(i)) for i in s.encode(x)]


def _brute(texts, coders):
    """By the definition, byte by byte: every pair of tokens over a byte is a link."""
    out, counts = [], collections.Counter()
    for text in texts:
        a, b = (c(text) for c in coders) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a, b = [], []
        over = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        links = sorted(set(zip(*over)))
        told, i, j, p, q = [], 0, 0, 0, 0
        while i < len(a):
            u, v = i, j
            p, q, i, j = p + len(a[i][1]), q + len(b[j][1]), i + 1, j + 1
            while p != q:
                if p < q:
                    p, i = p + len(a[i][1]), i + 1
                else:
                    q, j = q + len(b[j][1]), j + 1
            told.append(",".join(str(x) for x, _ in a[u:i]) + "|" + ",".join(str(x) for x, _ in b[v:j]))
        pairs = [(a[x][0], b[y][0]) for x, y in links]
        counts.update(pairs)
        out.append((len(a), len(b), len(told), pairs, hashlib.sha256(";".join(told).encode()).hexdigest() if told else "", told))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [(n_a, n_b, n, len(pairs), sum(counts[x] == top[x[1]] for x in pairs), sum(counts[x] for x in pairs), sha) for n_a, n_b, n, pairs, sha, _ in out], [x[5] for x in out]


def _texts():
    random.seed(3)
    signs = ["a", "b", "the ", "naïve", " ", "  ", "\n", "\t", "漢", "字", "😀", "́", "é", "1", "23", "'s", "<|endoftext|>", "<s>", "\x00", "ﬁ", "'"]
    made = ["".join(random.choice(signs) for _ in range(random.randint(1, 60))) for _ in range(80)]
    return [None, "", " ", "x", "▁ mark", "a" * 300, " " * 200, *made, made[0], made[0], "word by word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 9 else None, t, "x") for i, t in enumerate(_texts())] + [(3, "x", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, rid string").repartition(3)


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(docs, coders, monkeypatch, small):
    if small:  # many blocks, slices and buckets
        for name, n in (("BLOCK", 64), ("TOKENS", 50), ("HELD", 20), ("BUCKET", 16), ("ROW", 4)):
            monkeypatch.setattr(align, name, n)
    rows = docs.select("doc_id", "text").collect()
    want, _ = _brute([r["text"] for r in rows], coders)
    got = align.align_digest(docs, A, B).collect()
    as_key = lambda x: (str(x[0]), *x[1:])
    assert sorted((as_key((r["doc_id"], *[r[c] for c in FIGURES])) for r in got), key=repr) == sorted((as_key((r["doc_id"], *w)) for r, w in zip(rows, want)), key=repr)


def test_small_settings_reach_the_workers(docs, coders, monkeypatch):
    """The machine itself in slices, as workers may not see what a test sets."""
    texts = [t for t in _texts() if t]
    a, b = align.ByteSide(A), align.PieceSide(B)
    _, told = _brute(texts, coders)
    machine, found = align.Machine(a, b), collections.defaultdict(list)
    rows = []
    for i, t in enumerate(texts):
        sides = [s.encode([t])[0] for s in (a, b)]
        if any(s.joined(x).tobytes() != (" " + t).encode() for s, x in zip((a, b), sides)):
            continue
        for k, s in ((0, a), (1, b)):
            block = (s.size[sides[k]].cumsum() - 1) // 40
            rows += [(i, int(at) * 40, k, sides[k][block == at]) for at in dict.fromkeys(block.tolist())]
    rows.sort(key=lambda r: r[:3])
    for p in range(0, len(rows), 3):
        part = rows[p : p + 3]
        import numpy as np

        docs_, flat, of, ends, other, common = machine.take([r[0] for r in part], [r[0] for r in part], np.array([r[2] for r in part]), np.array([len(r[3]) for r in part]), [align._pack(r[3]) for r in part])
        machine.digest(docs_, flat, of, common, other)
        for d in docs_:
            found[d.rid] = d
    assert all(not len(x) for x in machine.left)
    for rid, d in found.items():
        assert d.sha.hexdigest() == hashlib.sha256(";".join(told[rid]).encode()).hexdigest()


def test_groups_as_rows(docs, coders):
    rows = docs.where("text is not null").select("doc_id", "text").collect()
    got = align.groups(docs, A, B).where("doc_id = 12").orderBy("begin").collect()
    text = next(r["text"] for r in rows if r["doc_id"] == 12)
    _, told = _brute([text], coders)
    assert [",".join(map(str, r["a_ids"])) + "|" + ",".join(map(str, r["b_ids"])) for r in got] == told[0]
    assert got[0]["begin"] == 0 and got[-1]["end"] == len((" " + text).encode()) and all(x["end"] == y["begin"] for x, y in zip(got, got[1:]))


def test_empty_table(docs):
    assert align.align_digest(docs.limit(0), A, B).count() == 0 and align.groups(docs.limit(0), A, B).count() == 0


def test_registered(spark, sf, coders):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, _ = _brute([r["text"] for r in rows], coders)
    got = {r["doc_id"]: tuple(r[c] for c in FIGURES) for r in queries.op11_tokenizer_alignment(spark, sf).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, want)}
    assert spark.read.parquet(f"{sf}/documents.parquet").agg(F.count("*")).first()[0] == len(got)
