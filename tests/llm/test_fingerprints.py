import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecscene.llm import fingerprints, queries


def _brute(text, k, ell, m):
    """Tuples by full sorts of (permuted hash, place), numbers among equals counted one by one."""
    h, numbered = fingerprints.elements(text, k)
    seen, own = {}, []
    kmers = [text[i : i + k] for i in range(max(1, len(text) - k + 1))]
    for x in kmers:
        own.append((x, seen.get(x, 0)))
        seen[x] = seen.get(x, 0) + 1
    assert len(set(own)) == len(own) == len(h)
    by = {}
    for x, v in zip(own, numbered.tolist()):
        assert by.setdefault(x, v) == v
    assert len(set(by.values())) == len(by)  # distinct elements have distinct hashes
    assert len(set(zip(kmers, h.tolist()))) == len(set(kmers)) == len(set(h.tolist()))
    drawn = []
    for f in fingerprints._FACTORS[:m].tolist():
        x = [((v & 0xFFFFFFFF) * f + (v >> 32)) & 0xFFFFFFFF for v in numbered.tolist()]
        drawn.append(tuple(kmers[i] for i in sorted(sorted(range(len(x)), key=lambda i: (x[i], i))[:ell])))
    return drawn


def test_tuples_are_those_of_the_definition():
    random.seed(1)
    texts = ["".join(random.choice("abé 漢") for _ in range(n)) for n in (1, 2, 5, 6, 30, 200)] + ["aaaaaaaaaaaaaaa", "abcabcabcabcabc" * 5]
    for k, ell, m in ((3, 2, 20), (4, 3, 9), (8, 2, 64)):
        told = {}
        for t in texts:
            for own, x in zip(_brute(t, k, ell, m), fingerprints.sketch(t, k, ell, m).tolist()):
                assert told.setdefault(x, own) == own  # one hash, one tuple
            assert np.array_equal(fingerprints.sketch(t, k, ell, m), fingerprints.sketch(t, k, ell, m))
        assert len(set(told.values())) == len(told)  # one tuple, one hash


def test_likeness_follows_edits_and_order():
    random.seed(2)
    text = "".join(random.choice("abcdefghij ") for _ in range(4000))
    one = fingerprints.sketch(text)

    def changed(n):
        x = list(text)
        for i in random.sample(range(len(x)), n):
            x[i] = "Z"
        return "".join(x)

    near = [np.mean([fingerprints.alike(one, fingerprints.sketch(changed(n))) for _ in range(4)]) for n in (0, 4, 40, 400)]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] and near[1] > 0.85
    # the same elements in another order: a MinHash of single elements would see next to no change
    blocks = [text[i : i + 100] for i in range(0, 4000, 100)]
    moved = "".join(reversed(blocks))
    assert fingerprints.alike(one, fingerprints.sketch(moved)) < 0.6 < fingerprints.alike(fingerprints.sketch(text, ell=1), fingerprints.sketch(moved, ell=1))


def test_permutations_are_fair():
    """The share of equal single minima is near the share of common elements."""
    random.seed(4)
    a, b, c = ("".join(random.choice("abcdefghijklmnop") for _ in range(3000)) for _ in range(3))
    x, y = fingerprints.sketch(a + b, ell=1, m=1000), fingerprints.sketch(a + c, ell=1, m=1000)
    assert abs(fingerprints.alike(x, y) - 1 / 3) < 0.06


def _expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    for i, (doc_id, text, _) in enumerate(order):
        after = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        new = fingerprints.edited(text, after)
        a, b, c = map(fingerprints.sketch, (text, new, after))
        yield (str(doc_id), len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprints._packed(a).hex(), fingerprints._packed(b).hex(), fingerprints.alike(a, b), fingerprints.alike(a, c))


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _held(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    got = sorted((str(r[0]), *r[1:]) for r in fingerprints.edit_likeness(docs).select(*COLUMNS).collect())
    assert got == sorted(_expected(rows))


@pytest.mark.parametrize("parts", [1, 7])
def test_against_a_global_sort(spark, parts):
    random.seed(5)
    texts = [None, "", "x", "ab", "a" * 50, "漢字 😀" * 9, *["".join(random.choice("abc \n") for _ in range(random.randint(0, 90))) for _ in range(60)], "long " * 5000]
    rows = [(i * 3, t, "z") for i, t in enumerate(texts)] + [(9, "other row of 9", "z"), (9, "other row of 9", "z"), (None, "no id", "z"), (None, None, "z")]
    _held(spark.createDataFrame(rows, "doc_id long, text string, tid string").repartition(parts))


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "just this one text")], "doc_id long, text string")
    _held(one)
    assert fingerprints.edit_likeness(one.limit(0)).count() == 0


def test_columns_alike(spark):
    random.seed(6)
    texts = ["", None, "abc", *["".join(random.choice("ab") for _ in range(40)) for _ in range(6)]]
    f = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    pairs = f.alias("a").join(f.alias("b"), F.expr("a.doc_id <= b.doc_id")).select("a.doc_id", F.col("b.doc_id").alias("other"), fingerprints.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("near")).collect()
    for r in pairs:
        assert r["near"] == fingerprints.alike(*(fingerprints.sketch(texts[i] or "") for i in (r["doc_id"], r["other"])))


def test_registered(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    got = sorted((str(r[0]), *r[1:]) for r in queries.op13_document_fingerprints(spark, sf).select(*COLUMNS).collect())
    assert got == sorted(_expected(rows))
    same = {}
    for r in got:
        same.setdefault(r[3], set()).add(r[1])
    assert all(len(x) == 1 for x in same.values())
