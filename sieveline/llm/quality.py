"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import releasing, saved, ship
from sieveline.llm.textarrays import hashes, mixed, slices, tokens

#: Word buckets (words are hashed), dimensions, non-zero entries of an index vector, neighbours to either side.
BUCKETS, DIMENSIONS, NONZERO, WINDOW = 1 << 14, 32, 4, 2
#: Buckets of one row of partial sums, and rows that one task of a summing round adds up.
BLOCK, FAN_IN = 128, 64
#: The classifier is fitted on at most so many labelled documents, those with the smallest hashed doc_id; a part of them calibrates.
MOST_LABELLED, CALIBRATION = 20_000, 0.2
HIDDEN, EPOCHS, STEP, BATCH, SEED = 32, 40, 0.01, 256, 11
THRESHOLD = 0.3
FEATURES = 2 * DIMENSIONS + 3

_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's random index vector; the same everywhere."""
    h = np.stack([mixed(np.arange(BUCKETS, dtype=np.uint64) * np.uint64(2 * NONZERO + 1) + np.uint64(k)) for k in range(NONZERO)])
    return (h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def bucketed(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token (runs of letters, digits and non-ASCII; runs of other printable characters) and its row."""
    starts, ends, row = tokens(data, rows, _KIND)
    return (hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), row


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Sums of the index vectors of each bucket's neighbours over all documents, as unit vectors (BUCKETS x DIMENSIONS).

    Each task adds up its documents in whole numbers and sends its table in blocks; blocks are added FAN_IN at a time, in as
    many rounds as the number of tasks asks for. Tables are of fixed size, whatever the corpus.
    """
    ship(docs.sparkSession)
    tasks = docs.rdd.getNumPartitions()

    def partial(batches):
        place, sign = index_vectors()
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            for _, _, data, rows in slices(batch.column(0)):
                word, row = bucketed(data, rows)
                for gap in range(1, WINDOW + 1):
                    near = row[:-gap] == row[gap:]
                    a, b = word[:-gap][near], word[gap:][near]
                    for x, y in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            total += np.bincount(x * DIMENSIONS + place[k][y], weights=sign[k][y], minlength=len(total))
        part = TaskContext.get().partitionId()
        blocks = total.astype(np.int64).reshape(-1, BLOCK * DIMENSIONS)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), part)), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=["block", "part", "sums"])

    def added(key, frame):
        total = np.zeros(BLOCK * DIMENSIONS, np.int64)
        for s in frame["sums"]:
            total += np.frombuffer(s, np.int64)
        return pd.DataFrame({"block": [key[0]], "part": [key[1]], "sums": [total.tobytes()]})

    kinds = "block long, part long, sums binary"
    sums = docs.select("text").mapInArrow(releasing(partial), kinds)
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        sums = sums.withColumn("part", F.pmod("part", F.lit(tasks)).cast("long")).groupBy("block", "part").applyInPandas(added, kinds)
    vectors = np.zeros((BUCKETS // BLOCK, BLOCK * DIMENSIONS))
    for r in sums.collect():
        vectors[r["block"]] += np.frombuffer(r["sums"], np.int64)
    vectors = vectors.reshape(BUCKETS, DIMENSIONS)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)).astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Features of each row: means and deviations of its tokens' vectors, the share of tokens like the one before, the mean's length, a squashed count."""
    word, row = bucketed(data, rows)
    n = len(rows) - 1
    out = np.zeros((n, FEATURES), np.float32)
    count = np.bincount(row, minlength=n)
    for lo in range(0, len(word), 1 << 17):
        hi = min(len(word), lo + (1 << 17))
        v = vectors[word[lo:hi]]
        first = np.flatnonzero(np.append(True, row[lo + 1 : hi] != row[lo : hi - 1]))
        at = row[lo:hi][first]
        out[at, :DIMENSIONS] += np.add.reduceat(v, first, axis=0)
        out[at, DIMENSIONS : 2 * DIMENSIONS] += np.add.reduceat(v * v, first, axis=0)
    k = np.maximum(count, 1)[:, None].astype(np.float32)
    mean, square = out[:, :DIMENSIONS] / k, out[:, DIMENSIONS : 2 * DIMENSIONS] / k
    out[:, :DIMENSIONS] = mean
    out[:, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[:, -3] = np.bincount(row[1:][(word[1:] == word[:-1]) & (row[1:] == row[:-1])], minlength=n) / k[:, 0]
    out[:, -2] = np.linalg.norm(mean, axis=1)
    out[:, -1] = np.log1p(np.minimum(count, 500)) / 6
    return out


def features(docs: DataFrame, vectors: np.ndarray, columns: list[str]) -> DataFrame:
    """The named columns of docs and features (FEATURES 32-bit floats)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def each(batches):
        for batch in batches:
            for lo, hi, data, rows in slices(batch.column(len(columns))):
                f = pooled(shared.value, data, rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(columns))), pa.array([x.tobytes() for x in f], pa.binary())], names=[*columns, "features"])

    docs = docs.select(*columns, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(releasing(each), f"{kinds}, features binary")


@dataclass
class Network:
    """Two layers on standardised features; temperature divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def constant(share: float) -> Network:
    """The same score for every text, for want of labels of both kinds."""
    p = min(max(share, 0.01), 0.99)
    return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Train by Adam on most of the rows, then choose the temperature with the least log loss on the rest. Same rows, same network."""
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    held = order[: max(1, int(len(y) * CALIBRATION))]
    used = order[len(held) :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    z, t = (x[used] - mean) / scale, y[used].astype(float)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for lo in range(0, len(t), BATCH):
            i = order[lo : lo + BATCH]
            a, b = z[i], t[i]
            h = np.maximum(a @ p[0] + p[1], 0)
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - b) / len(i)
            back = np.outer(e, p[2]) * (h > 0)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= STEP * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logit, truth = net.logits(x[held]), y[held]
    heats = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
    loss = [np.mean(np.logaddexp(0, np.where(truth == 1, -1, 1) * logit / c)) for c in heats]
    net.temperature = float(heats[int(np.argmin(loss))])
    return net


def held_out(doc_id: str = "doc_id"):
    """True for documents whose labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def labelled_sample(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality of the labelled documents to learn from: among ids, not held out, at most MOST_LABELLED, by hashed doc_id."""
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out())
    return saved(known.join(ids.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(MOST_LABELLED), "sample")


def train(rows: DataFrame, sample: DataFrame) -> Network:
    """Fit on the features of the sample; rows: doc_id, features. The sample has at most MOST_LABELLED rows, so it is broadcast."""
    got = rows.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "features").limit(MOST_LABELLED).select("quality", "features").toPandas()
    x = np.stack([np.frombuffer(f, np.float32) for f in got["features"]]).astype(float) if len(got) else np.zeros((0, FEATURES))
    return fit(x, got["quality"].to_numpy(dtype=int))


def _scored(rows: DataFrame, net: Network) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(net)
    at = rows.columns.index("features")
    names = [c for c in rows.columns if c != "features"]

    def each(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(at).to_pylist()), np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(shared.value.scores(x.astype(float)))], names=[*names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "features")
    return rows.mapInArrow(releasing(each), f"{kinds}, score double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Word vectors are gathered from all documents, labels only from those not held out. A null or empty text has zero features and
    its score. A null doc_id counts as not held out and has no label. Repeated rows stay; without labels of both kinds all scores are equal.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(features(docs, word_vectors(docs), ["doc_id"]), "features")
    out = _scored(rows, train(rows, labelled_sample(docs, labels)))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, with predicted 1. Texts stay where they are: they are scored again in place of a join.

    A null text is scored as an empty one; a null doc_id has no label but is scored; repeated rows are each kept or not alike; an empty table gives none.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = word_vectors(slim)
    sample = labelled_sample(slim, labels)
    net = train(features(slim.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi"), vectors, ["doc_id"]), sample)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    at = names.index("text")

    def each(batches):
        vectors, net = shared.value
        for batch in batches:
            for lo, hi, data, rows in slices(batch.column(at)):
                keep = net.scores(pooled(vectors, data, rows).astype(float)) >= THRESHOLD
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(releasing(each), docs.schema)
