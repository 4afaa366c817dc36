import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from vecscene.llm import queries, runs


def _brute(s, exponent, least):
    """Every maximal stretch of each period, and whether a smaller period has it too."""
    n, out = len(s), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, exponent * q) and not any(all(s[x] == s[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def _sequences(seed):
    random.seed(seed)
    for _ in range(250):
        rows, a = [], random.randint(1, 3)
        for _ in range(random.randint(1, 4)):
            n = random.randint(0, 45)
            x = [random.randrange(a) for _ in range(n)]
            if random.random() < 0.5:
                x = ([random.randrange(a + 2) for _ in range(random.randint(1, 9))] * 12)[:n]
                for _ in range(random.randint(0, 2) if x else 0):
                    x[random.randrange(len(x))] = random.randrange(a + 2)
            rows.append(x)
        yield rows + rows[: random.randint(0, 1)]


def _as_chunk(rows):
    return np.array([w for x in rows for w in x], np.int64), np.repeat(np.arange(len(rows)), [len(x) for x in rows])


@pytest.mark.parametrize("exponent, least", [(2, 2), (2.5, 3), (3, 2), (4, 6)])
def test_all_runs(exponent, least):
    for rows in _sequences(int(10 * exponent) + least):
        start, length, period = runs.runs_of(*_as_chunk(rows), exponent, least)
        base = np.cumsum([0] + [len(x) for x in rows])
        want = sorted((i + int(base[k]), n, q) for k, x in enumerate(rows) for i, n, q in _brute(x, exponent, least))
        assert sorted(zip(start.tolist(), length.tolist(), period.tolist())) == want


def test_walks_complete_the_vocabulary(monkeypatch):
    """From one covering square of each class of rotations that meet in the text, walks reach the same vocabulary."""
    for rows in list(_sequences(77))[:80]:
        s = np.append(np.array([w for x in rows for w in x], np.int64), 99)
        t = runs.Suffixes(s)
        squares = {tuple(s[i : i + 2 * k]) for i in range(len(s)) for k in range(1, (len(s) - i) // 2 + 1) if np.array_equal(s[i : i + k], s[i + k : i + 2 * k])}
        whole = {x for x in squares if not any(len(x) // 2 % d == 0 and x[d:] == x[:-d] for d in range(1, len(x) // 2))}
        low, high, k = runs.vocabulary(t)
        assert {tuple(s[t.order[a] : t.order[a] + 2 * n]) for a, n in zip(low, k)} == whole and len(k) == len(whole)
        for a, b, n in zip(low, high, k):  # the leaves below a locus are all places of its square
            x = s[t.order[a] : t.order[a] + 2 * n]
            assert {i for i in range(len(s)) if np.array_equal(s[i : i + 2 * n], x)} == set(t.order[a : b + 1].tolist())
        # a walk that begins in the middle, and has to go on at another place
        for x in list(whole)[:5]:
            half = x[: len(x) // 2]
            chain, y = set(), x
            while y in whole and y not in chain:
                chain.add(y)
                y = y[1:] + y[len(half) : len(half) + 1]
            at = next(i for i in range(len(s)) if tuple(s[i : i + len(x)]) == x)
            monkeypatch.setattr(runs, "covering", lambda t, at=at, k=len(half): (np.array([at]), np.array([k])))
            low, _, k = runs.vocabulary(t)
            assert {tuple(s[t.order[a] : t.order[a] + 2 * n]) for a, n in zip(low, k)} == chain
            monkeypatch.undo()


def test_blocks_and_extensions():
    random.seed(3)
    for _ in range(40):
        s = np.array([random.randrange(2) for _ in range(random.randint(1, 50))] + [7])
        t = runs.Suffixes(s)
        n = len(s)
        assert t.order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        i, j = 0, []
        while i < n:
            j.append(i)
            longest = max((m for b in range(i) for m in range(n - i) if np.array_equal(s[b : b + m], s[i : i + m])), default=0)
            i += max(1, longest)
        assert t.blocks().tolist() == j
        a, b = (np.array([random.randrange(n) for _ in range(60)]) for _ in range(2))
        a, b = a[a != b], b[a != b]
        ahead = [next(m for m in range(n + 1) if max(x, y) + m >= n or s[x + m] != s[y + m]) for x, y in zip(a, b)]
        back = [next(m for m in range(n + 1) if min(x, y) - m < 0 or s[x - m] != s[y - m]) for x, y in zip(a, b)]
        assert t.forward(a, b).tolist() == ahead and t.backward(a, b).tolist() == back


def _expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n and not (h := zlib.crc32(str(doc_id).encode())) % 10:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = _brute(w, 4, 6)
    gone = {i for a, size, q in found for i in range(a + q, a + size)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (str(doc_id), len(found), *map(str, told), sha("".join("%d,%d,%d\n" % x for x in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _got(df):
    return sorted((str(r[0]), r[1], *map(str, r[2:6]), *r[6:]) for r in df.select(*COLUMNS).collect())


def test_digest_against_brute_force(spark):
    random.seed(8)
    say = lambda n, a: " ".join(random.choice(["ab", "c", "naïve", "漢字", "x-y", "a" * 20][:a]) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "a " * 50, "a b " * 30 + "c", "x " + "p q r " * 8 + "p y", "a b c " * 9, *[say(random.randint(0, 120), random.randint(1, 6)) for _ in range(150)]]
    texts += [f"{say(5, 6)} {'k l m n ' * 5}{'k l ' * 7}{say(4, 2)}", "head " + "w1 w2 w3 w4 w5 " * 40 + "tail"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1), (None, "a b a b a b a b a b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = _got(runs.run_digest(df))
    assert got == sorted(_expected(i, t) for i, t, _ in rows)
    assert sum(x[1] > 0 for x in got) > 40


def test_runs_and_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "so so so so so so  it\ngoes on"), (2, "plain  text"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in runs.runs(df, 4, 4).collect()] == [(1, 0, 6, 1)]
    assert {r["doc_id"]: r["text"] for r in runs.collapse(df).collect()} == {1: "so it goes on", 2: "plain  text", 3: None}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert runs.run_digest(none).count() == runs.runs(none).count() == runs.collapse(none).count() == 0


def test_long_texts():
    """One word, two words in turn, and a Fibonacci word of 50,000 words."""
    one = runs.runs_of(np.zeros(50_000, np.int64), np.zeros(50_000, np.int64))
    assert [x.tolist() for x in one] == [[0], [50_000], [1]]
    a, b = [0], [0, 1]
    while len(b) < 50_000:
        a, b = b, b + a
    start, length, period = runs.runs_of(np.array(b), np.zeros(len(b), np.int64), 3, 2)
    assert len(start) and (length >= 3 * period).all() and (length < 3.7 * period).all()


def test_registered(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"] for r in rows if len(r["text"] or "") < 6000}  # the brute force is quadratic
    got = _got(queries.op12_periodic_runs(spark, sf))
    assert len(got) == len(rows)
    assert [x for x in got if int(x[0]) in short] == sorted(_expected(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in short)
