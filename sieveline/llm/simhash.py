"""SimHash near-duplicates: fingerprints, blocks that close pairs must share, Hamming checks, components."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import join_skewed, releasing, saved, ship, small, with_row_key, without
from sieveline.llm.components import components

SEED = 42
#: Rows of a block that are compared in one go.
BLOCK_ROWS = 2048
_hash = xxhash.xxh64_intdigest


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of the lower-cased word shingles of a text, repeats included; 0 without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        h = [_hash(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, w), np.int64, len(w))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        h = [_hash(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(np.array(h[i : i + 8192], ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the fingerprint's bits as a long) of every document."""
    ship(docs.sparkSession)

    def each(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(releasing(each), "doc_id long, th long, fp long")


def block_plan(n: int, bits: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks (lowest bit, width) of 64 bits, and the sets of blocks whose equality finds every pair with at most so many differing bits.

    With m blocks at least m - bits are equal in such a pair, so one of the sets of m - bits blocks is. m is the least for
    which a set has two bits more than it takes to number n fingerprints: chance meetings stay under one per fingerprint and set.
    """
    for m in range(bits + 1, 2 * bits + 9):
        edges = [round(i * 64 / m) for i in range(m + 1)]
        blocks = [(a, b - a) for a, b in itertools.pairwise(edges)]
        if (m - bits) * (64 // m) >= math.log2(max(n, 1)) + 2 or m == 2 * bits + 8:
            return blocks, list(itertools.combinations(range(m), m - bits))
    raise AssertionError


def _forest(fp: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """Pairs of rows with equal key (rows sorted by it) and fingerprints within bits; in long runs of a key only as many as connect them."""
    n, found, k = len(fp), [], 1
    live = np.arange(n)
    while True:
        live = live[live + k < n]
        live = live[key[live] == key[live + k]]
        if not len(live):
            break
        near = live[np.bitwise_count(fp[live] ^ fp[live + k]) <= bits]
        found.append(np.stack([near, near + k], axis=1))
        k += 1
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return spanning(pairs, n) if len(pairs) > n else pairs


def spanning(pairs: np.ndarray, n: int) -> np.ndarray:
    """Those of the pairs of numbers under n that connect what all of them connect, without a cycle."""
    up = list(range(n))
    kept = []
    for i, (a, b) in enumerate(pairs.tolist()):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(i)
    return pairs[kept]


def close_links(fps: DataFrame, n: int, bits: int) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp) of which n exist: together they connect all pairs within so many bits.

    Each fingerprint goes to every set of blocks under that set's key; a partition of keys is sorted and compared in numpy.
    Keys with over BLOCK_ROWS fingerprints are cut into parts by hash, and every pair of parts is a key of its own, so no task
    compares a whole hot block. A task sends the links that span what it found, so rows stay in proportion to fingerprints.
    """
    blocks, sets = block_plan(n, bits)

    def part(b: tuple[int, int]):
        return F.shiftrightunsigned("fp", b[0]).bitwiseAND(F.lit((1 << b[1]) - 1))

    keys = []
    for i, chosen in enumerate(sets):
        key = F.lit(i).cast("long")
        for b in chosen:
            key = F.shiftleft(key, blocks[b][1]).bitwiseOR(part(blocks[b]))
        keys.append(key)
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = saved(keyed.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK_ROWS).withColumn("parts", F.ceil(F.col("c") / BLOCK_ROWS).cast("int")).drop("c"), "hot")
    one, two = F.lit(0), F.lit(0)
    if hot.limit(1).count():
        mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        others = F.sequence(F.lit(0), F.col("parts") - 1)
        pairs = F.transform(others, lambda o: F.struct(F.least(o, mine).alias("one"), F.greatest(o, mine).alias("two")))
        cool = F.array(F.struct(F.lit(0).alias("one"), F.lit(0).alias("two")))
        keyed = keyed.join(small(hot, 100_000), "key", "left").select("fp", "key", F.explode(F.when(F.col("parts").isNull(), cool).otherwise(pairs)).alias("p"))
        one, two = F.col("p.one"), F.col("p.two")
    keyed = keyed.select("fp", F.xxhash64("key", one, two).alias("key"))

    def each(batches):
        rest_fp, rest_key = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            fp = np.concatenate([rest_fp, batch.column(0).to_numpy().view(np.uint64)])
            key = np.concatenate([rest_key, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            rest_fp, rest_key = fp[cut:], key[cut:]
            yield links(fp[:cut], key[:cut])
        yield links(rest_fp, rest_key)

    def links(fp, key):
        pairs = _forest(fp, key, bits)
        return pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, 0]].view(np.int64)), pa.array(fp[pairs[:, 1]].view(np.int64))], names=["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(releasing(each), "a long, b long")


#: Order of the rows of a component: by doc_id, those without one last, then by text. The first one names the component and stays.
def _place():
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))


def classes(docs: DataFrame, bits: int = 4) -> DataFrame:
    """doc_id, th, fp of every document, and first: the first row (last, doc_id, th) that chains of links within so many bits reach.

    Rows with equal fingerprints, and fingerprints of one component, may be a third of all: they are pre-aggregated, and the joins
    back broadcast the hot ones (join_skewed).
    """
    spark = docs.sparkSession
    marks = saved(fingerprints(docs), "fingerprints")
    distinct = saved(marks.groupBy("fp").agg(F.min(_place()).alias("least"), F.count("*").alias("rows")), "distinct")
    n, total = distinct.count(), marks.count()
    links = saved(close_links(distinct.select("fp"), n, bits), "close") if n else spark.createDataFrame([], "a long, b long")
    found = components(links)
    rooted = saved(distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "rooted")
    firsts = saved(rooted.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n")), "firsts")
    named = saved(join_skewed(rooted.drop("least"), firsts, ["root"], "n", n).select("fp", "rows", "first"), "named")
    return join_skewed(marks, named, ["fp"], "rows", total).select("doc_id", "th", "fp", "first")


def near_duplicates(docs: DataFrame, bits: int = 4) -> DataFrame:
    """doc_id, fp and component_id of every document: the smallest doc_id that chains of links within so many bits reach.

    Documents without words (null or empty texts too) have fingerprint 0 and link like any other. Repeated rows stay repeated; a
    null doc_id keeps its row and never names a component, unless nothing else is in it. Other columns are ignored.
    """
    return classes(docs, bits).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, bits: int = 4) -> DataFrame:
    """One row of each component, all columns: that with the smallest doc_id (rows without one come last), of these the first by a hash of the text.

    Rows are told apart by doc_id and text, so a doc_id that stands at different texts loses none of them; of rows equal in both one stays. The
    rows to drop are joined to the texts, by broadcast while they are few.
    """
    rows = saved(classes(docs, bits), "classes")
    stays = _place() == F.col("first")
    kept = without(docs, rows.where(~stays).select("doc_id", "th"))
    often = rows.where(stays).groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1")
    often = saved(often.select(F.coalesce("doc_id", F.lit(0)).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("th").alias("c")), "often")
    if often.limit(1).count():
        keyed, keys = with_row_key(kept, F.xxhash64("text"))
        some = small(often.toDF(*keys), 2_000_000)
        kept = keyed.join(some, keys, "left_anti").unionByName(keyed.join(some, keys, "left_semi").dropDuplicates(keys))
    return kept.select(*docs.columns)
