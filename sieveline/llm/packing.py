"""Best-fit packing of token pieces into sequences of a fixed capacity, planned on the counts of their lengths.

Pieces of one length are alike to a packer, so the plan is made of groups of equal sequences: it needs how many pieces each length has, a table of at
most `capacity` rows whatever the corpus, and has at most a few groups for each length. Pieces longer than a third of the capacity are matched
first: at most two of them fit into a sequence, and the longest left takes the longest partner that fits. The shorter ones then go, longest
first, where they leave the smallest gap. Spark numbers the pieces of each length; a piece's number says which place of the plan is its own.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.bpe import text_runs, vocabulary_path
from sieveline.llm.common import releasing, saved, ship, small
from sieveline.llm.tokenfiles import encoder

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that a task numbers in a row before it begins another block.
BLOCK = 256


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, where asked ids, and part, own (which piece of its length it is in its task) of every document.

    A document's ids are those of its text and end_id; what is longer than capacity is cut into pieces of capacity, the last one shorter. A null text is
    empty and has end_id alone. Repeated rows, also under one or a null doc_id, are documents of their own.
    """
    ship(docs.sparkSession)
    path = vocabulary_path(vocabulary)

    def each(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        e, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo, hi, texts in text_runs(batch.column(1)):
                row, piece, ids = [], [], []
                for i, x in enumerate(e.encode(texts)):
                    x += end
                    cut = range(0, len(x), 4 * capacity)
                    row += [i] * len(cut)
                    piece += range(len(cut))
                    ids += [x[at : at + 4 * capacity] for at in cut]
                length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                own = np.empty(len(ids), np.int64)
                own[order] = np.arange(len(ids)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                number = np.array(piece, np.int64)
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(row, pa.int64())), pa.array(number), pa.array(number * capacity), pa.array(length), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(np.full(len(ids), part)), pa.array(own)]
                if with_ids:
                    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "own", *["ids"] * with_ids]
    schema = "doc_id long, piece long, start long, length long, ids_crc32 long, part long, own long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(each), schema)


def packed_groups(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, pieces of it in each sequence)]): how to pack so many pieces of each length."""
    n = {length: k for length, k in counts.items() if k}
    groups: list[tuple[int, int, list[tuple[int, int]]]] = []  # sequences, gap, content
    large = sorted(length for length in n if 3 * length > capacity)
    while large:
        longest = large[-1]
        at = bisect.bisect_right(large, capacity - longest) - 1
        if at >= 0 and large[at] == longest and n[longest] == 1:
            at -= 1
        if at < 0:
            times, content = n[longest], [(longest, 1)]
        elif large[at] == longest:
            times, content = n[longest] // 2, [(longest, 2)]
        else:
            times, content = min(n[longest], n[large[at]]), [(longest, 1), (large[at], 1)]
        groups.append((times, capacity - sum(a * b for a, b in content), content))
        for length, k in content:
            n[length] -= times * k
            if not n[length]:
                large.remove(length)
    by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for times, gap, content in groups:
        by_gap.setdefault(gap, []).append((times, content))
    gaps = sorted(by_gap)

    def put(times: int, gap: int, content: list[tuple[int, int]]) -> None:
        if gap not in by_gap:
            bisect.insort(gaps, gap)
            by_gap[gap] = []
        by_gap[gap].append((times, content))

    for length in sorted((x for x in n if 3 * x <= capacity and n[x]), reverse=True):
        left = n[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            gap = gaps[at] if at < len(gaps) else capacity
            if at < len(gaps):
                times, content = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap], gaps[at]
            else:
                times, content = left, []  # new sequences, no more than needed
            each = gap // length  # a sequence with the smallest gap keeps it until it is full
            full = min(times, left // each)
            rest = left - full * each if full < times else 0
            if full:
                put(full, gap - each * length, [*content, (length, each)])
            if rest:
                put(1, gap - rest * length, [*content, (length, rest)])
            if content and times - full - bool(rest):
                put(times - full - bool(rest), gap, content)
            left -= full * each + rest
    return [(times, content) for gap in gaps for times, content in by_gap[gap]]


def places(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, sequence, each, offset): the pieces lo to hi - 1 of a length fill sequences from that one on, each of them with so many from offset on."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for times, content in packed_groups(counts, capacity):
        offset = 0
        for length, each in content:
            lo = taken.get(length, 0)
            taken[length] = lo + times * each
            out.append((length, lo, lo + times * each, sequence, each, offset))
            offset += each * length
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of pieces, a saved table of token_pieces(), with sequence_id and offset. An empty table gives no rows.

    Blocks of at most BLOCK pieces of a length are counted, so a length that a third of all rows have is many groups; the plan is made from the sums by length, at
    most capacity rows.
    """
    block = F.floor(F.col("own") / BLOCK).alias("block")
    blocks = saved(pieces.groupBy("length", "part", block).agg(F.count("*").alias("n")), "blocks")
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = pieces.sparkSession.createDataFrame(places(counts, capacity), "length long, lo long, hi long, sequence long, each long, at long")
    before = Window.partitionBy("length").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.select("length", "part", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.withColumn("block", block).join(small(first, 200_000), ["length", "part", "block"]).withColumn("number", F.col("first") + F.col("own") % BLOCK)
    there = numbered.join(F.broadcast(plan.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi")))
    nth = F.col("number") - F.col("lo")
    return there.select(*pieces.columns, (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, where asked ids, sequence_id, offset of every piece of every document."""
    pieces = saved(token_pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces")
    return pack(pieces, capacity).drop("part", "own")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, starts (where each piece begins), doc_ids of every sequence; packed has ids. A group is one sequence, so at most capacity ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    by = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return by.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts"), F.col("parts.doc_id").alias("doc_ids"))
