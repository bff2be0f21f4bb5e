"""Runs of words against a plain search of every period, on random and built strings, and whole documents."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from sieveline.llm import tandem


def plain_runs(words, least_words=2, least_periods=2):
    """Every maximal stretch with a period, tried for each period; the smallest period of a stretch counts."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= 2 * q:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in out.items() if b >= max(least_words, least_periods * q))


def found(strings):
    s, begin, end = [], [], []
    for k, one in enumerate(strings):
        begin.append(len(s))
        s += [1000 * (k + 1) + x for x in one]
        end.append(len(s))
        s.append(10**6 + k)
    at, length, period = tandem.runs(np.array(s), np.array(begin), np.array(end))
    out = [[] for _ in strings]
    for a, n, q in zip(at.tolist(), length.tolist(), period.tolist(), strict=True):
        k = np.searchsorted(begin, a, side="right") - 1
        out[k].append((a - begin[k], n, q))
    return [sorted(x) for x in out]


def test_all_runs_of_random_and_built_strings():
    rng = random.Random(12)
    strings = [[0] * n for n in range(1, 9)] + [[0, 1] * 9 + [0], [0, 0, 1] * 5 + [2] + [0, 0, 1] * 4, [0]]
    for _ in range(1500):
        strings.append([rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(rng.randrange(1, 40))])
    for _ in range(300):
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
        strings.append([rng.randrange(3) for _ in range(rng.randrange(6))] + (root * 8)[: rng.randrange(1, 40)] + [rng.randrange(3) for _ in range(rng.randrange(9))] + (root * 3)[rng.randrange(3) :])
    a, b = [0], [0, 1]
    while len(b) < 300:  # a Fibonacci string has as many runs as there can be, or nearly
        a, b = b, b + a
    strings.append(b)
    for one, got in zip(strings, found(strings), strict=True):
        assert got == plain_runs(one), one


def test_the_filter_keeps_every_word_of_a_run(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(tandem, "SYMBOLS", 40)
    texts = []
    for _ in range(400):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            root = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (root * 9)[: rng.randrange(1, 9 * len(root))]
        texts.append(words)
    for least_words, least_periods in ((6, 4), (6, 3), (9, 4), (4, 2)):
        data = np.frombuffer(" ".join(w for t in texts for w in t).encode(), np.uint8)
        starts = np.arange(0, len(data), 2)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        before = np.append(0, np.cumsum([len(t) for t in texts]))
        out = [[] for _ in texts]
        for w, n, q in zip(*(x.tolist() for x in tandem.row_runs(data, starts, starts + 1, row, least_words, least_periods)), strict=True):
            out[row[w]].append((w - int(before[row[w]]), n, q))
        for words, got in zip(texts, out, strict=True):
            assert sorted(got) == plain_runs(words, least_words, least_periods), words


def plain_digest(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    own = plain_runs(words, 6, 4)
    gone = {i for a, b, q in own for i in range(a + q, a + b)}
    top = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(own), *best, sha("".join(f"{a},{b},{q}\n" for a, b, q in own)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_documents_against_the_plain_search(spark, docs, empty):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab cd e  é x".split(" ")) for _ in range(rng.randrange(300)))) for i in range(100, 400)]
    rows += [(i, "\t \n x y \x1c " * rng.randrange(30)) for i in range(400, 430)] + [(None, "a b " * 9), (5, None), (6, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1))
    got = [tuple(r) for r in tandem.digests(tandem.find(df, planted=True)).collect()]
    assert sorted(got, key=str) == sorted((plain_digest(*r) for r in rows), key=str)
    assert sum(g[1] > 0 for g in got) > 50
    small = docs.where("length(text) < 1000 or text is null")
    got = [tuple(r) for r in tandem.digests(tandem.find(small, planted=True)).collect()]
    assert sorted(got, key=str) == sorted((plain_digest(r["doc_id"], r["text"]) for r in small.collect()), key=str)
    assert tandem.digests(tandem.find(empty)).count() == 0


def test_long_repetitive_texts_are_linear():
    import time

    took = []
    for n in (20_000, 80_000):
        one = [i % 5000 for i in range(n)]
        began = time.time()
        assert found([one]) == [[(0, n, 5000)]]
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 1
