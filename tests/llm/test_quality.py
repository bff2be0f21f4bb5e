"""Word vectors and pooled features against plain loops over words."""

import random
import re

import numpy as np
import pyarrow as pa

from sieveline.llm import quality as q
from sieveline.llm.textarrays import slices


def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "été", "日本", "x1", "--", "!?", "a-b", "the", "the", "of", "\n", "\x00"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(46)]
    return [*made, None, "", "same same same", "word " * 700]


def words_of(text):
    return re.findall(rb"[A-Za-z0-9\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode())


def bucket_of(word, known={}):  # noqa: B006
    if word not in known:
        known[word] = next(int(q.bucketed(data, rows)[0][0]) for _, _, data, rows in slices(pa.array([word.decode()])))
    return known[word]


def plain_vectors(all_texts):
    place, sign = q.index_vectors()
    total = np.zeros((q.BUCKETS, q.DIMENSIONS))
    for text in all_texts:
        some = [bucket_of(w) for w in words_of(text)]
        for i, x in enumerate(some):
            for j in range(max(0, i - q.WINDOW), min(len(some), i + q.WINDOW + 1)):
                if j != i:
                    for k in range(q.NONZERO):
                        total[x, place[k][some[j]]] += sign[k][some[j]]
    for x in range(q.BUCKETS):
        size = np.sqrt((total[x] ** 2).sum())
        total[x] /= max(size, 1)
    return total


def plain_features(text, vectors):
    some = [bucket_of(w) for w in words_of(text)]
    n = max(len(some), 1)
    mean = sum((vectors[x].astype(float) for x in some), np.zeros(q.DIMENSIONS)) / n
    square = sum((vectors[x].astype(float) ** 2 for x in some), np.zeros(q.DIMENSIONS)) / n
    like = sum(a == b for a, b in zip(some, some[1:], strict=False)) / n
    return [*mean, *np.sqrt(np.maximum(square - mean**2, 0)), like, np.sqrt((mean**2).sum()), np.log1p(min(len(some), 500)) / 6]


def test_vectors_and_features_equal_plain_loops(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(7)
    vectors = q.word_vectors(docs)
    assert np.allclose(vectors, plain_vectors(rows), atol=1e-6)
    got = {r["doc_id"]: np.frombuffer(r["features"], np.float32) for r in q.features(docs, vectors, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        assert np.allclose(got[i], plain_features(text, vectors), atol=2e-3), i


def test_fit_is_repeatable_and_tells_classes_apart():
    rng = np.random.default_rng(3)
    y = (np.arange(400) % 2).astype(int)
    x = rng.normal(0, 1, (400, q.FEATURES)) + y[:, None] * 0.8
    one, two = q.fit(x, y), q.fit(x, y)
    assert np.array_equal(one.scores(x), two.scores(x))
    assert ((one.scores(x) >= 0.5) == y).mean() > 0.95
    assert abs(q.fit(x[:5], y[:5]).scores(x)[0] - y[:5].mean()) < 1e-9
