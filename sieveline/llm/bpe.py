"""Word-level BPE over a partition: an index from each pair to all its positions, merged in ascending rank."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import releasing, ship
from sieveline.llm.textarrays import distinct, slices, tokens

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Bytes of text whose distinct words are encoded together.
BATCH_BYTES = 2 << 20
#: White space beyond ASCII that parts words, and all of it; \x1c-\x1f are no white space here.
_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = regex.compile(rf"[\t-\r {_WIDE}]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")

_WORD = np.ones(256, np.uint8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0


def vocabulary_path(path: str | None = None) -> str:
    """path, or the installed word vocabulary."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class PairIndex:
    """Merges the symbols of many words at once.

    Symbols stand in one array, words one after another, with links to the left and right neighbour. For every rank the positions
    of its pair are kept; ranks are applied in ascending order, each to all its positions, and the pairs that a merge makes
    are added to the lists of their ranks. Stale positions are recognised when their rank comes up.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        model = t["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.size = max(vocab.values()) + 1
        self.names = {i: s for s, i in vocab.items()} | {a["id"]: a["content"] for a in t["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in t["added_tokens"]}
        self.numbers = [str(i) for i in range(self.size)]
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in self.added) + ")") if self.added else None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        codes = self.left * self.size + self.right
        self.by_code = np.argsort(codes, kind="stable")
        self.codes = codes[self.by_code]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for pairs that are never merged."""
        code = left * self.size + right
        i = np.searchsorted(self.codes, code)
        i[i == len(self.codes)] = 0
        return np.where(self.codes[i] == code, self.by_code[i], -1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and where each word's ids end."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        if not n:
            return np.zeros(0, np.int64), ends
        symbol = np.append(self.inner[data], -1)
        symbol[ends - 1] = self.last[data[ends - 1]]
        follow = np.arange(1, n + 2)
        follow[ends - 1] = n
        before = np.arange(-1, n)
        before[np.append(0, ends[:-1])] = -1
        todo: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            known = rank >= 0
            at, rank = at[known], rank[known]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if r in todo:
                    todo[r].append(part)
                else:
                    todo[r] = [part]
                    heapq.heappush(heap, r)

        inside = np.flatnonzero(follow[:n] < n)
        add(inside, self.ranks(symbol[inside], symbol[inside + 1]))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(todo.pop(r)))
            a, b, made = self.left[r], self.right[r], self.made[r]
            at = at[symbol[at] == a]
            at = at[symbol[follow[at]] == b]
            if a == b and len(at) > 1:
                chained = np.append(False, follow[at[:-1]] == at[1:])
                i = np.arange(len(at))
                first = np.maximum.accumulate(np.where(chained, 0, i))
                at = at[(i - first) % 2 == 0]
            if not len(at):
                continue
            gone = follow[at]
            after = follow[gone]
            symbol[at], symbol[gone] = made, -2
            follow[at] = after
            inner = after < n
            before[after[inner]] = at[inner]
            ahead = before[at]
            ahead, here = ahead[ahead >= 0], at[inner]
            where = np.concatenate([ahead, here])
            if len(where):
                add(where, self.ranks(symbol[where], symbol[follow[where]]))
        alive = symbol[:n] >= 0
        return symbol[:n][alive], np.cumsum(alive)[ends - 1]


@functools.lru_cache(maxsize=2)
def _index(path: str) -> PairIndex:
    return PairIndex(path)


def normal(text: str) -> str:
    """NFC, lower case letter by letter."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")
    return text.lower()


def words_of(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w]


def pieces_of(word: str) -> list[str]:
    if word.isalpha():
        return [word]
    if word[-1] in ",.;:!?" and word[:-1].isalpha():
        return [word[:-1], word[-1]]
    return _PIECE.findall(word)


class Words:
    """The distinct words of many normal texts, and which word stands where: the words of row i are distinct[which[bounds[i]:bounds[i+1]]]."""

    def __init__(self, texts: list[str]):
        self.which, self.distinct, self.bounds = np.zeros(0, np.int32), [], np.zeros(1, np.int64)
        raw = [" ".join(words_of(t)) if not t.isascii() and any(c in t for c in _WIDE) else t for t in texts]
        for lo, hi, data, rows in slices(pa.array(raw, pa.large_string()), 1 << 62):
            starts, ends, row = tokens(data, rows, _WORD)
            first, which = distinct(data, starts, ends)
            order = np.argsort(first)  # words in the order of the texts
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            self.which = place[which]
            first, view = first[order], data.tobytes()
            self.distinct = [view[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            self.bounds = np.append(0, np.cumsum(np.bincount(row, minlength=hi - lo)))


def pieces(words: list[str]) -> tuple[list[str], list[list[int]]]:
    """Distinct pieces of distinct words, and the pieces of each word."""
    known: dict[str, int] = {}
    put = known.setdefault
    cut = [[put(w, len(known))] if w.isalpha() else [put(p, len(known)) for p in pieces_of(w)] for w in words]
    return list(known), cut


def parts_of(text: str, index: PairIndex) -> list[tuple[bool, str]] | None:
    """A text that holds added tokens, as (is one, normal text) parts; None for all other texts."""
    if index.special is None or "<" not in text or not index.special.search(text):
        return None
    return [(p in index.added, p if p in index.added else normal(p)) for p in index.special.split(text) if p]


def text_runs(column: pa.Array):
    """Lists of texts of about BATCH_BYTES; null texts are empty."""
    for lo, hi, _, _ in slices(column, BATCH_BYTES):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def encoded(index: PairIndex, texts: list[str]):
    """(ids in decimal, decoded text) of each text, both joined by a space."""
    parts = {i: p for i, t in enumerate(texts) if (p := parts_of(t, index))}
    plain = [part for i, t in enumerate(texts) for part in (parts.get(i) or [(False, normal(t))])]
    words = Words(["" if special else t for special, t in plain])
    some, cut = pieces(words.distinct)
    ids, ends = index.encode(some)
    bounds, names = [0, *ends.tolist()], index.names
    number = index.numbers
    flat = ids.tolist()
    as_ids = [" ".join([number[i] for i in flat[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    as_text = [" ".join([names[i] for i in flat[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    del flat
    word_ids = [as_ids[c[0]] if len(c) == 1 else " ".join([as_ids[i] for i in c]) for c in cut]
    word_text = [as_text[c[0]] if len(c) == 1 else " ".join([as_text[i] for i in c]) for c in cut]
    row = 0
    for i in range(len(texts)):
        out_ids, out_text = [], []
        for special, t in parts.get(i) or [(False, "")]:
            if special:
                out_ids.append(str(index.added[t]))
                out_text.append(t)
            else:
                which = words.which[words.bounds[row] : words.bounds[row + 1]].tolist()
                if which:
                    out_ids.append(" ".join([word_ids[k] for k in which]))
                    out_text.append(" ".join([word_text[k] for k in which]))
            row += 1
        yield " ".join(out_ids), " ".join(out_text)


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, and ids where asked; docs keeps no other column.

    A null text is an empty one: no ids, digests of nothing. Ids are those of the vocabulary file's tokenizer without special
    tokens added; added tokens that stand in a text are found. decoded_sha256 is over the ids' symbols joined by a space,
    which is how a vocabulary without a decoder reads back.
    """
    ship(docs.sparkSession)
    path = vocabulary_path(path)

    def each(batches):
        index = _index(path)
        for batch in batches:
            for lo, hi, texts in text_runs(batch.column(1)):
                n, ids_sha, text_sha, flat = [], [], [], []
                for ids, decoded in encoded(index, texts):
                    n.append(ids.count(" ") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        flat.append(np.array(ids.split(), np.int32))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                if with_ids:
                    sizes = np.append(0, np.cumsum([len(x) for x in flat])).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(flat))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(each), schema)
