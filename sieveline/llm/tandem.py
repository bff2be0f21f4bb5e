"""Periodic runs of words: all tandem repeats by Lempel-Ziv blocks and suffix-link walks (Gusfield and Stoye, 2004), merged into runs.

Many texts are worked on at once. Words that no run of the asked size can hold part a text into segments; the segments, each with symbols of its own
and an end symbol of its own, make one string. Its suffix tree is held as the sorted suffixes with the common prefixes of neighbours: a node is an
interval of suffixes, its suffix link the interval of the same string less its first symbol.

1. Blocks: each is the longest prefix of what is left that also begins further to the left. Common extensions to both sides of the block borders give
   squares (i, k), two equal halves of k symbols from i on, that cover the leftmost place of every square.
2. Walks: from each of them the square one place to the right is looked for, by the suffix link and the edge of the symbol it begins with; steps inside
   one run need no looking. A walk ends where nothing follows, where another one has passed, or after k steps. So every kind of square is met.
3. The interval of each kind has all its places; squares of one k that begin side by side are one run.

Only squares with a primitive half are kept, so k is the run's smallest period.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import releasing, ship
from sieveline.llm.textarrays import distinct, hashes, mixed, numbered, rolled, slices, tokens

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Symbols that are searched together, at most, unless one text has more.
SYMBOLS = 1 << 18
SLICE_BYTES = 2 << 20
_WORD = np.ones(256, np.uint8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each start, so many as its size."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class SuffixTree:
    """The suffix tree of a string of numbers whose last one is unique: order and common prefixes of its suffixes."""

    def __init__(self, s: np.ndarray):
        n = self.n = len(s)
        self.s = s
        #: names[l][i] tells the 2**l symbols from i on apart, in their order; -1 beyond the end.
        self.names = [np.append(np.unique(s, return_inverse=True)[1], -1).astype(np.int32)]
        width = 1
        while int(self.names[-1].max()) + 1 < n:
            name = self.names[-1].astype(np.int64)
            ahead = np.full(n, -1, np.int64)
            ahead[: max(0, n - width)] = name[width:n]
            self.names.append(np.append(np.unique(name[:n] * (n + 1) + ahead + 1, return_inverse=True)[1], -1).astype(np.int32))
            width *= 2
        self.rank = self.names[-1][:n].astype(np.int64)
        self.order = np.argsort(self.rank)
        common = np.zeros(n, np.int32)  # of a suffix and the one before it
        common[1:] = self.forward(self.order[:-1], self.order[1:])
        #: least[l][x] is the least common prefix of x to x + 2**l - 1.
        self.least = [common]
        for level in range(max(1, n).bit_length() - 1):
            half, last = 1 << level, self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common prefix of the suffixes at i and at j, two different places."""
        i, j, start = i.copy(), j.copy(), i
        for level in range(len(self.names) - 1, -1, -1):
            name = self.names[level]
            same = name[np.minimum(i, self.n)] == name[np.minimum(j, self.n)]
            i[same] += 1 << level
            j[same] += 1 << level
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i and before j, two different places, are equal."""
        i, j, start = i.copy(), j.copy(), i
        for level in range(len(self.names) - 1, -1, -1):
            name, a, b = self.names[level], i - (1 << level), j - (1 << level)
            same = (a >= 0) & (b >= 0)
            same &= name[np.maximum(a, 0)] == name[np.maximum(b, 0)]
            i[same], j[same] = a[same], b[same]
        return start - i

    def node(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """lo and hi: the suffixes lo to hi - 1 of the order begin with the length symbols at each place."""
        lo = self.rank[at]
        hi = lo.copy()
        for level in range(len(self.least) - 1, -1, -1):
            least, step = self.least[level], 1 << level
            down, up = lo - step + 1, hi + 1  # the entries that must reach length
            ok = down >= 0
            ok &= least[np.clip(down, 0, len(least) - 1)] >= length
            lo[ok] -= step
            ok = up + step <= self.n
            ok &= least[np.clip(up, 0, len(least) - 1)] >= length
            hi[ok] += step
        return lo, hi + 1

    def child(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """A place of each node's string, which has depth symbols, followed by the symbol; -1 where there is none."""
        end = hi
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = self.order[np.minimum(mid, self.n - 1)] + depth
            less = open_ & (self.s[np.minimum(at, self.n - 1)] < symbol)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        at = self.order[np.minimum(lo, self.n - 1)]
        found = (lo < end) & (self.s[np.minimum(at + depth, self.n - 1)] == symbol)
        return np.where(found, at, -1)

    def earlier(self) -> np.ndarray:
        """The longest prefix of each suffix that also begins at an earlier place."""
        order = self.order.tolist()
        below, above, stack = [-1] * self.n, [-1] * self.n, []
        for at in order:  # the nearest suffixes, to both sides of the order, that begin earlier
            while stack and stack[-1] > at:
                above[stack.pop()] = at
            if stack:
                below[at] = stack[-1]
            stack.append(at)
        here, out = np.arange(self.n), np.zeros(self.n, np.int64)
        for other in (np.array(below), np.array(above)):
            known = other >= 0
            out[known] = np.maximum(out[known], self.forward(here[known], other[known]))
        return out


def covering_squares(tree: SuffixTree, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half): squares that cover the leftmost place of every square of each segment begin to end - 1, with primitive halves."""
    reach = np.maximum(tree.earlier(), 1).tolist()
    block, follow, beyond, first = [], [], [], []  # where a block, the next one and the one after it begin; and its segment
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        h = a
        cuts = [a]
        while h < b:
            h = min(b, h + reach[h])
            cuts.append(h)
        block += cuts[:-1]
        follow += cuts[1:]
        beyond += [*cuts[2:], b]
        first += [(a, b)] * (len(cuts) - 1)
    h, h1, h2 = np.array(block), np.array(follow), np.array(beyond)
    a, b = np.array(first).reshape(-1, 2).T
    s = tree.s
    # the right border of a block: second halves that begin left of it
    size = np.where(h1 < b, h1 - h, 0)
    of, k = np.repeat(np.arange(len(h)), size), _ranges(np.ones(len(h), np.int64), size)
    q, border = h1[of] - k, h1[of]
    hit = s[q] == s[border]
    q, k, border = q[hit], k[hit], border[hit]
    right, left = tree.forward(border, q), tree.backward(border, q)
    start = np.maximum(q - left, q - k + 1)
    one = right + left >= k
    # the left border: first halves that begin left of it and end in the block
    size = np.where(h > a, np.minimum(h2, b) - h - 1, 0).clip(0)
    of, j = np.repeat(np.arange(len(h)), size), _ranges(np.ones(len(h), np.int64), size)
    border, p = h[of], h[of] + j
    hit = (s[p] == s[border]) & (s[p - 1] == s[border - 1])
    border, p, j, of = border[hit], p[hit], j[hit], of[hit]
    right, left = tree.forward(border, p), tree.backward(border, p)
    begins = np.maximum(border - left, border - j + 1)
    two = (right + left >= j) & (begins + j <= h1[of])
    start, k = np.concatenate([start[one], begins[two]]), np.concatenate([k[one], j[two]])
    return _primitive(tree, start, k)


def _primitive(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The squares whose half is no repetition of something shorter."""
    keep = np.ones(len(k), bool)
    rest, prime = k.copy(), 2
    while len(rest) and prime <= int(rest.max()):
        if prime * prime > int(rest.max()):  # what is left of each is a prime or one
            at = np.flatnonzero(rest > 1)
            step = k[at] // rest[at]
            keep[at] &= tree.forward(start[at], start[at] + step) < k[at] - step
            break
        at = np.flatnonzero(rest % prime == 0)
        if len(at):
            step = k[at] // prime
            keep[at] &= tree.forward(start[at], start[at] + step) < k[at] - step
            while len(at):
                rest[at] //= prime
                at = at[rest[at] % prime == 0]
        prime += 1
    return start[keep], k[keep]


def vocabulary(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, half): the tree's node of every kind of square with a primitive half, each once, from covering squares."""
    known: np.ndarray = np.zeros(0, np.int64)
    lows, highs, halves = [], [], []
    width = tree.n + 1
    while len(start):
        run = tree.forward(start, start + k) - k  # how many squares of this half follow inside the run
        size = np.minimum(run, k - 1) + 1
        at, half = _ranges(start, size), np.repeat(k, size)
        lo, hi = tree.node(at, 2 * half)
        key = lo * width + half
        fresh, where = np.unique(key, return_index=True)
        new = ~np.isin(fresh, known, assume_unique=True)
        known = np.union1d(known, fresh[new])
        where = where[new]
        lows.append(lo[where])
        highs.append(hi[where])
        halves.append(half[where])
        # beyond the run: by the suffix link to the square less its first symbol, then along that symbol's edge
        open_ = run < k - 1
        at, k = start[open_] + run[open_], k[open_]
        lo, hi = tree.node(at + 1, 2 * k - 1)
        start = tree.child(lo, hi, 2 * k - 1, tree.s[at])
        there = start >= 0
        start, k = start[there], k[there]
        lo, _ = tree.node(start, 2 * k)
        passed = np.isin(lo * width + k, known)
        key, where = np.unique((lo * width + k)[~passed], return_index=True)
        start, k = start[~passed][where], k[~passed][where]
    if not lows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(lows), np.concatenate(highs), np.concatenate(halves)


def runs(s: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of two periods and more in the segments begin to end - 1 of s.

    Segments share no symbol, and after each stands one symbol that stands nowhere else.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not len(begin):
        return none
    tree = SuffixTree(s)
    lo, hi, half = vocabulary(tree, *covering_squares(tree, begin, end))
    if not len(lo):
        return none
    at = tree.order[_ranges(lo, hi - lo)]
    k = np.repeat(half, hi - lo)
    order = np.lexsort((at, k))
    at, k = at[order], k[order]
    new = np.append(True, (at[1:] != at[:-1] + 1) | (k[1:] != k[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] - at[first] + 2 * k[first], k[first]


def gram_size(least_words: int, least_periods: int) -> int:
    """The most words of which each place in a run has some that stand in the run again, one period on or back."""
    return max(1, min(max(least_words, least_periods * q) - 2 * q + 1 for q in range(1, least_words + 1)))


def repeated(h: np.ndarray, row: np.ndarray, gram: int) -> np.ndarray:
    """Whether each word stands in some gram words that its row has twice or more, as far as hashes tell (too many then, never too few)."""
    out = np.zeros(len(h) + 1, np.int64)
    if len(h) >= gram:
        inside = np.flatnonzero(row[: len(h) - gram + 1] == row[gram - 1 :])
        g = mixed(rolled(h, gram)[inside] + row[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(g)
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(g), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(out, inside[twice], 1)
        np.add.at(out, inside[twice] + gram, -1)
    return np.cumsum(out)[:-1] > 0


def row_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, length, period) of the runs of at least so many words and periods; words are runs of bytes of data, row by row, and runs stay in their row."""
    h = hashes(data, starts, ends)
    kept = np.flatnonzero(repeated(h, row, gram_size(least_words, least_periods)))
    out = [[], [], []]
    if len(kept):
        new = np.append(True, (kept[1:] != kept[:-1] + 1) | (row[kept[1:]] != row[kept[:-1]]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(kept)))
        long = size >= least_words
        first, size = first[long], size[long]
        lo = 0
        while lo < len(first):
            hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(size[lo:]), SYMBOLS, side="right")))
            n, m = size[lo:hi], hi - lo
            words = kept[_ranges(first[lo:hi], n)]
            segment = np.repeat(np.arange(m), n)
            symbol = numbered(segment, distinct(data, starts[words], ends[words])[1])
            begin = np.cumsum(n + 1) - n - 1
            s = np.empty(len(words) + m, np.int64)
            s[_ranges(begin, n)] = symbol
            s[begin + n] = int(symbol.max()) + 1 + np.arange(m)
            at, length, period = runs(s, begin, begin + n)
            ok = (length >= least_words) & (length >= least_periods * period)
            at, length, period = at[ok], length[ok], period[ok]
            of = np.searchsorted(begin, at, side="right") - 1
            for x, y in zip(out, (kept[first[lo:hi][of]] + at - begin[of], length, period), strict=True):
                x.append(y)
            lo = hi
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def made_periodic(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original word that stands at each place of a document of n words, where the operator's contract has its tail repeated; else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % (1 + (n - a) // (3 + g % 8)), i)


def find(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, planted: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the text's words but for a run's repetitions) of every document.

    Words are what ASCII white space parts. A word is left out of collapsed if some run holds it after that run's first period. planted: the tails of some
    documents are repeated first, as made_periodic() says. A null text is an empty one, without words; a null doc_id stays null and is never planted. Each row
    is searched on its own, so repeated rows repeat in the result. An empty table gives no rows. A text is worked on as a whole, in one task.
    """
    ship(docs.sparkSession)

    def each(batches):
        for batch in batches:
            for lo, hi, data, rows in slices(batch.column(1), SLICE_BYTES):
                ids = batch.column(0).slice(lo, hi - lo)
                starts, ends, row = tokens(data, rows, _WORD)
                n = np.bincount(row, minlength=hi - lo)
                before = np.append(0, np.cumsum(n))
                if planted:
                    place = np.arange(len(starts))
                    for i, d in enumerate(ids.to_pylist()):
                        if (there := made_periodic(d, int(n[i]))) is not None:
                            place[before[i] : before[i + 1]] = before[i] + there
                    starts, ends = starts[place], ends[place]
                word, length, period = row_runs(data, starts, ends, row, least_words, least_periods)
                of = row[word]
                start = word - before[of]
                order = np.lexsort((period, start, of))
                dropped = np.zeros(len(starts) + 1, np.int64)
                np.add.at(dropped, word + period, 1)
                np.add.at(dropped, word + length, -1)
                keep = np.cumsum(dropped)[:-1] == 0
                starts, size = starts[keep], (ends - starts)[keep] + 1
                # all kept words one after another, each with a space behind it
                total = np.append(0, np.cumsum(size))
                flat = np.append(data, np.uint8(32))[np.minimum(_ranges(starts, size), len(data))]
                flat[total[1:] - 1] = 32
                cut = total[np.append(0, np.cumsum(np.bincount(row[keep], minlength=hi - lo)))].tolist()
                view = flat.tobytes()
                text = [view[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                found = pa.StructArray.from_arrays([pa.array(x[order]) for x in (start, length, period)], names=["start", "length", "period"])
                many = np.append(0, np.cumsum(np.bincount(of, minlength=hi - lo))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.ListArray.from_arrays(pa.array(many), found), pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(each), schema)


def digests(found: DataFrame) -> DataFrame:
    """Of the rows of find(): doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    Exponents are compared exactly; ties go to the smallest start, then period. A document without runs has four nulls.
    """

    def each(batches):
        for batch in batches:
            best, listed = [], []
            for own in batch.column(1).to_pylist():
                top = min(own, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)
                best.append((top["start"], top["length"], top["period"], 1000 * top["length"] // top["period"]) if top else (None,) * 4)
                listed.append(hashlib.sha256("".join(f"{r['start']},{r['length']},{r['period']}\n" for r in own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in batch.column(1)], pa.int64()), *(pa.array([b[i] for b in best], pa.int64()) for i in range(4)), pa.array(listed, pa.string()), batch.column(2)], names=names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = found.select("doc_id", "runs", F.sha2("collapsed", 256).alias("sha"))
    return rows.mapInArrow(each, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
