"""Benchmark decontamination by q-gram lemma filtering over diagonal bands and banded alignment."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import releasing, saved, ship, small, without

#: Characters of a q-gram (eight one-byte codes make a machine word) and edits allowed per character of a passage.
Q, EDITS = 8, 0.06
#: Longer passages are looked for in pieces of PIECE characters, one every half of it, so that a document that holds a part of one is found.
PIECE = 160
#: Characters of benchmark text that one pass over the documents looks for, and of document text that is looked at together.
PASS_CHARS, RUN_CHARS = 1 << 21, 1 << 20
#: A q-gram at more places of the passages is common: it is counted only in passages that have too few others. Hits that are counted at once.
COMMON, HITS = 64, 1 << 21


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    """A byte for each character: its code below 256, else a mix of it. Equal characters have equal bytes, so no q-gram in common is missed."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(wide < 256, wide, (wide * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def qgrams(code: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    if len(code) < Q:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(code, Q)).view(np.uint64).ravel()


def budget(m: int) -> int:
    """Edits allowed in a passage of m characters: EDITS of them, but so few that the lemma still asks for a q-gram."""
    return max(0, min(int(m * EDITS), (m - Q) // Q))


def cut(text: str) -> list[tuple[int, str]]:
    """(offset, piece) of a normal passage: itself, or overlapping pieces, the last one at its end."""
    if len(text) <= PIECE:
        return [(0, text)]
    return [(at, text[at : at + PIECE]) for at in sorted({*range(0, len(text) - PIECE, PIECE // 2), len(text) - PIECE})]


class PassageIndex:
    """The q-grams of a list of distinct passages, the rarest of each, for looking up q-grams of documents. Passages under Q characters are found as such.

    A match with k edits keeps all but k Q of a passage's q-grams, whichever of them are counted. So common ones are left out as long as k Q + 1
    others remain, and least is so many less.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in items if len(t) >= Q]
        self.short = [(i, t) for i, t in items if 0 < len(t) < Q]
        grams = [qgrams(codes(t)) for _, t in self.items]
        gram = np.concatenate([np.zeros(0, np.uint64), *grams])
        sizes = np.array([len(g) for g in grams], np.int64)
        item = np.repeat(np.arange(len(grams)), sizes)
        place = np.arange(len(gram)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.edits = np.array([budget(len(t)) for _, t in self.items], np.int64)
        _, which, times = np.unique(gram, return_inverse=True, return_counts=True)
        times = times[which]
        rare = np.bincount(item[times <= COMMON], minlength=len(grams))
        counted = np.minimum(sizes, np.maximum(rare, self.edits * Q + 1))
        self.least = counted - self.edits * Q
        order = np.lexsort((times, item))
        rank = np.arange(len(gram)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        chosen = order[rank < counted[item]]
        chosen = chosen[np.argsort(gram[chosen], kind="stable")]
        self.item, self.place = item[chosen], place[chosen]
        self.grams, self.first, self.count = np.unique(gram[chosen], return_index=True, return_counts=True)
        self.step = self.edits + 1
        self.shift = np.uint64(64 - max(16, int(len(self.grams) * 16).bit_length()))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self._slot(self.grams)] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def regions(self, code: np.ndarray):
        """(item numbers, first diagonals), part by part, of bands with as many hits as the lemma asks for.

        A match with k edits keeps its q-grams on k + 1 neighbouring diagonals (text position less passage position). Bands are
        2 (k + 1) wide and begin every k + 1, so one of them holds them all. Hits come in the order of the text, HITS at a time; a band is
        settled when the text has moved beyond its reach, so what is held does not grow with all hits.
        """
        g = qgrams(code)
        if not len(g) or not len(self.grams):
            return
        at = np.flatnonzero(self.maybe[self._slot(g)])
        g = g[at]
        i = np.searchsorted(self.grams, g)
        i[i == len(self.grams)] = 0
        true = self.grams[i] == g
        at, i = at[true], i[true]
        del g, true
        if not len(at):
            return
        most = int(self.size.max())
        width = len(code) + most + 2
        part = (np.cumsum(self.count[i]) - 1) // HITS
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(at)]
        keys, hits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            n = self.count[i[lo:hi]]
            hit = np.repeat(self.first[i[lo:hi]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = self.item[hit]
            band = (np.repeat(at[lo:hi], n) - self.place[hit] + most) // self.step[item]
            new, times = np.unique(np.concatenate([item * width + band, (item * width + band - 1)[band > 0]]), return_counts=True)
            keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            hits = np.bincount(where, np.concatenate([hits, times]), len(keys)).astype(np.int64)
            item, band = keys // width, keys % width
            done = np.ones(len(keys), bool) if hi == len(at) else (band + 2) * self.step[item] - most + self.size[item] < at[hi]
            enough = done & (hits >= self.least[item])
            yield item[enough], band[enough] * self.step[item[enough]] - most
            keys, hits = keys[~done], hits[~done]


def aligned(passage: str, text: str, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of passage in text on diagonals low..high, widened by most; None beyond most edits.

    Row i of the table holds the cost of the passage's first i characters ending at text[i + low - most ..]; costs move along a row
    by a running minimum, starts travel with them.
    """
    a = np.frombuffer(passage.encode("utf-32-le", "surrogatepass"), np.uint32)
    b = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = low - most
    width = high - low + 2 * most + 1
    far = np.int64(1 << 20)
    j = np.arange(width)
    end = j + shift  # text position before which the row's cell ends, for i = 0
    scale = np.int64(1 << 32)  # cost and start in one number: the smallest cost, then the last start
    cost = np.where((end >= 0) & (end <= len(b)), (1 << 31) - end, far * scale)
    along = j * scale
    for i in range(1, len(a) + 1):
        last = end + i - 1  # index of the character that the cell ends with
        ok = (last >= 0) & (last < len(b))
        same = np.zeros(width, bool)
        same[ok] = b[last[ok]] == a[i - 1]
        fresh = np.where(ok, cost + np.where(same, 0, scale), far * scale)
        fresh[:-1] = np.minimum(fresh[:-1], cost[1:] + scale)
        fresh = np.minimum(fresh, np.minimum.accumulate(fresh - along) + along)
        out = (last + 1 < 0) | (last + 1 > len(b))
        fresh[out] = far * scale
        cost = fresh
    best = int(np.argmin(cost))
    edits = int(cost[best] // scale)
    if edits > most:
        return None
    return edits, (1 << 31) - int(cost[best] % scale), int(end[best]) + len(a)


def matches(index: PassageIndex, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(row, number, start, end, edits) of every passage found in normal texts: its best place in each."""
    starts = np.cumsum([0, *(len(t) + Q for t in texts)])
    joined = ("\0" * Q).join(texts)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}

    def keep(row: int, k: int, start: int, end: int, edits: int) -> None:
        old = found.get((row, k))
        if old is None or (edits, start) < (old[2], old[0]):
            found[row, k] = (start, end, edits)

    for k, d in ((k, d) for item, low in index.regions(codes(joined)) for k, d in zip(item.tolist(), low.tolist(), strict=True)):
        size, most = int(index.size[k]), int(index.edits[k])
        high = d + 2 * int(index.step[k]) - 1
        passage = index.items[k][1]
        first, last = max(0, int(np.searchsorted(starts, d - most, "right")) - 1), min(len(texts) - 1, int(np.searchsorted(starts, high + size + most, "left")))
        for row in range(first, last + 1):
            text, at = texts[row], int(starts[row])
            old = found.get((row, k))
            if old is not None and old[2] == 0 and at + old[0] <= d:
                continue
            lo = max(0, d - most - at)
            piece = text[lo : max(0, high + size + most + 1 - at)]
            exact = piece.find(passage)
            if exact >= 0:
                keep(row, k, lo + exact, lo + exact + size, 0)
            elif len(piece) >= size - most and (hit := aligned(passage, piece, max(d - at - lo, -most), high - at - lo, most)):
                keep(row, k, lo + hit[1], lo + hit[2], hit[0])
    out = [(row, index.items[k][0], s, e, n) for (row, k), (s, e, n) in found.items()]
    for item_id, passage in index.short:
        for row, text in enumerate(texts):
            if (at := f" {text} ".find(f" {passage} ")) >= 0:
                out.append((row, item_id, at, at + len(passage), 0))
    return sorted(out)


def pieces(benchmark: DataFrame) -> DataFrame:
    """item_id, at, of, text: the pieces of every passage in normal form, where each begins and how many the passage has."""

    def each(batches):
        for batch in batches:
            rows = [(i, at, len(some), t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for some in [cut(normal(text))] for at, t in some]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["item_id", "at", "of", "text"])

    some = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    return some.mapInArrow(releasing(each), "item_id long, at int, of int, text string").where("text <> ''")


_kept: dict[str, PassageIndex] = {}


def _index(name: str, items: list[tuple[int, str]]) -> PassageIndex:
    """The index of a pass, which a worker makes once and keeps until the next pass."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = PassageIndex(items)
    return _kept[name]


def _found(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """doc_id, th, piece, start_char, end_char, edits of every numbered piece in the documents."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def each(batches):
        index = _kept.get(name) or _index(name, shared.value)
        for batch in batches:
            texts = batch.column(2)
            lo = 0
            while lo < batch.num_rows:
                run, hi, chars = [], lo, 0
                while hi < batch.num_rows and (hi == lo or chars < RUN_CHARS):
                    run.append(normal(texts[hi].as_py()))
                    chars += len(run[-1])
                    hi += 1
                hits = matches(index, run)
                rows = pa.array([lo + h[0] for h in hits], pa.int64())
                own = [batch.column(0).take(rows), batch.column(1).take(rows)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([h[c] for h in hits], kind) for c, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.int32())))], names=["doc_id", "th", "piece", "start_char", "end_char", "edits"])
                lo = hi

    out = saved(docs.mapInArrow(releasing(each), "doc_id long, th long, piece long, start_char long, end_char long, edits int"), "found")
    shared.destroy()
    return out


def _held(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, item_id, best (edits, start_char, end_char), n_pieces, of, rows: leaks() by document text, with the number of equal rows."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    some = saved(pieces(benchmark), "pieces")
    chars = some.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-chars // PASS_CHARS)
    texts = saved(some.select("text").distinct().select("text", F.monotonically_increasing_id().alias("piece"), F.pmod(F.xxhash64("text"), F.lit(max(passes, 1))).alias("pass")), "texts")
    out = spark.createDataFrame([], "doc_id long, th long, piece long, start_char long, end_char long, edits int")
    for p in range(passes):
        items = [(r["piece"], r["text"]) for r in texts.where(F.col("pass") == p).select("piece", "text").orderBy("piece").toLocalIterator()]
        out = out.unionByName(_found(docs, items)) if items else out
    owners = some.join(texts, "text").select("piece", "item_id", "at", "of")
    best = F.struct("edits", "start_char", "end_char")
    placed = out.join(owners, "piece").groupBy("doc_id", "th", "item_id", "at").agg(F.min(best).alias("best"), F.count("*").alias("rows"), F.first("of").alias("of"))
    return placed.groupBy("doc_id", "th", "item_id").agg(F.min("best").alias("best"), F.count("*").cast("int").alias("n_pieces"), F.max("rows").alias("rows"), F.first("of").alias("of"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_char, end_char, edits, n_pieces, of: the benchmark passages of which a document holds a piece within the edit budget.

    Texts are compared in normal(); places count its characters and are those of the piece with the fewest edits, then the first; n_pieces of the
    passage's pieces were found. Passages up to PIECE characters are one piece. One under Q characters must stand as whole words; an empty or null
    one is never found. The pieces stay a table; each pass over the documents takes about PASS_CHARS of them, dealt by a hash, so the driver holds
    one pass at a time. Repeated documents each have their rows, repeated benchmark rows count once; a null id is an id.
    """
    each = _held(docs, benchmark).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "item_id", "best.start_char", "best.end_char", "best.edits", "n_pieces", "of")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, in which leaks() finds nothing. Rows are told apart by doc_id and text; one without doc_id goes if its text leaks."""
    return without(docs, _held(docs, benchmark).select("doc_id", "th"))
