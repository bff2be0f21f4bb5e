"""Whole texts as numpy arrays: tokens of many Arrow strings at once, told apart by their bytes, and 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 1 << 21
#: Runs of more bytes are hashed one by one.
LONG = 64


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES):
    """(first row, last row + 1, bytes, row offsets) of runs of rows with at most limit bytes, or of one longer row. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def tokens(data: np.ndarray, rows: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of one non-zero class of member (256 entries), and the row of each; runs end with their row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    kind = member[data]
    new = np.empty(len(data), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[rows[:-1][rows[:-1] < len(data)]] = True
    edges = np.flatnonzero(new)
    ends = np.append(edges[1:], len(data))
    keep = kind[edges] != 0
    starts, ends = edges[keep], ends[keep]
    return starts, ends, np.searchsorted(rows, starts, side="right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros beyond the end."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def _limb(loads: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from at, of which left belong to the run."""
    x = loads[at]
    part = left < 8
    x[part] &= (np.uint64(1) << (left[part].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
    return x


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes. Runs of one length up to eight bytes have equal hashes only if they are equal."""
    size = ends - starts
    h = size.astype(np.uint64) * np.uint64(BASE)
    loads = _loads(data)
    live, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - k
        h[live] = mixed(h[live] ^ _limb(loads, starts[live] + k, left))
        live, k = live[left > 8], k + 8
    view = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(view[starts[i] : ends[i]])
    return h


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): the first place of each distinct run of bytes, and the number of each run's own. Equal hashes are compared byte by byte."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = hashes(data, starts, ends)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    size, twin = ends - starts, first[which]
    same = bool((size == size[twin]).all())
    loads, k = _loads(data), 8
    live = np.flatnonzero((size > 8) & (twin != np.arange(len(size))))
    long = live[size[live] > LONG]
    live = live[size[live] <= LONG]
    if same and k < LONG and len(live):
        same = bool((loads[starts[live]] == loads[starts[twin[live]]]).all())
    while same and len(live):
        left = size[live] - k
        same = bool((_limb(loads, starts[live] + k, left) == _limb(loads, starts[twin[live]] + k, left)).all())
        live, k = live[left > 8], k + 8
    view = memoryview(np.ascontiguousarray(data))
    same = same and all(view[starts[i] : ends[i]] == view[starts[j] : ends[j]] for i, j in zip(long.tolist(), twin[long].tolist(), strict=True))
    if not same:  # two runs share a hash
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(bytes(view[a:b]), len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.unique(which, return_index=True)[1]
    return first, which


def numbered(*keys: np.ndarray) -> np.ndarray:
    """A number under len(keys[0]) for each row of the keys (numbers from 0), equal for equal rows only."""
    out = keys[0].astype(np.int64)
    for key in keys[1:]:
        width = int(key.max()) + 1 if len(key) else 1
        if len(out) and (int(out.max()) + 1) * width >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
        out = out * width + key
    return np.unique(out, return_inverse=True)[1]


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive values; the caller drops those that cross a row."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + h[i : i + n]
    return mixed(out)


def hash_of(word: bytes) -> int:
    """hashes() of one word."""
    a = np.frombuffer(word, dtype=np.uint8)
    return int(hashes(a, np.array([0]), np.array([len(a)]))[0])
