"""Token-id files: one zstandard frame per document, compressed with a dictionary trained on id arrays, and an offset index.

A file, little-endian: MAGIC; the dictionary's sha256 (32 bytes); frames, one after another; the index, ENTRY for each document; TAIL
(where the index starts, documents). The dictionary lies beside the files as dictionary-<sha256>.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.bpe import Words, normal, pieces, text_runs, vocabulary_path
from sieveline.llm.common import saved, shared_path, ship

MAGIC = b"SVTOKID1"
#: doc_id (its smallest value for null), where its frame starts, its bytes, its ids, ids before it in this file.
ENTRY = np.dtype([("doc_id", "<i8"), ("at", "<u8"), ("size", "<u8"), ("n", "<u8"), ("start", "<u8")])
TAIL = "<QQ"
NO_ID = -(1 << 63)
END_ID = 1
#: The dictionary: its bytes, the documents that it is trained on (those with the smallest hashes of doc_id and text), the ids in a
#: training piece, and the bytes of pieces at most.
DICTIONARY_BYTES, SAMPLE_DOCUMENTS, PIECE_IDS, SAMPLE_BYTES = 1 << 16, 2000, 512, 16 << 20
LEVEL = 1
#: Words, the first that it meets, that a worker remembers the ids of.
REMEMBERED = 300_000
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Texts to little-endian 32-bit ids by the tokenizers library, which sees each distinct piece of a run of texts once.

    The vocabulary's normalizer and splitter never join what white space parts, so the ids of a text are those of its pieces, in
    order. Pieces are normal already: the library's model gets them parted by spaces, and the last id of each ends a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if hasattr(self.model.model, "_resize_cache"):
            self.model.model._resize_cache(0)  # no piece comes twice
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.known: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def _pieces(self, some_pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and where each one's end."""
        flat, ends = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        at = 0
        for lo in range(0, len(some_pieces), 50_000):
            some = some_pieces[lo : lo + 50_000]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) != len(some):  # a piece with a character that the splitter takes for white space
                each = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(some, add_special_tokens=False)]
                ids, end = np.concatenate(each), np.cumsum([len(e) for e in each])
            flat.append(ids)
            ends.append(end + at)
            at += len(ids)
        return np.concatenate(flat), np.concatenate(ends)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        some, cut = pieces(words)
        ids, ends = self._pieces(some)
        starts = np.append(0, ends[:-1])
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        piece = np.fromiter((i for c in cut for i in c), np.int64, int(n.sum()))
        sizes = (ends - starts)[piece]
        total = np.append(0, np.cumsum(sizes))
        return ids[_ranges(starts[piece], sizes)], total[np.cumsum(n)] - total[np.cumsum(n) - n]

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [any(a in t for a in self.added) for t in texts]
        words = Words(["" if o else normal(t) for t, o in zip(texts, odd, strict=True)])
        look = self.known.get
        slot = np.fromiter((look(w, -1) for w in words.distinct), np.int64, len(words.distinct))
        unknown = np.flatnonzero(slot < 0)
        new = [words.distinct[i] for i in unknown.tolist()]
        ids, n = self._words(new)
        starts = np.cumsum(n) - n + len(self.ids)
        slot[unknown] = np.arange(len(new)) + len(self.known)
        flat = np.concatenate([self.ids, ids]).astype("<u4")
        start, size = np.concatenate([self.start, starts]), np.concatenate([self.size, n])
        if room := max(0, min(len(new), REMEMBERED - len(self.known))):
            self.known.update(zip(new[:room], range(len(self.known), len(self.known) + room)))
            self.start, self.size = start[: len(self.known)], size[: len(self.known)]
            self.ids = flat[: int(self.start[-1] + self.size[-1])].copy()
        at = slot[words.which]
        per_word = np.append(0, np.cumsum(size[at]))
        out = flat[_ranges(start[at], size[at])]
        bounds = per_word[words.bounds].tolist()
        return [np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if o else out[a:b].tobytes() for t, o, a, b in zip(texts, odd, bounds[:-1], bounds[1:], strict=True)]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each start, so many as its size."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if urlparse(path).scheme else (pyarrow.fs.LocalFileSystem(), path)


def put(path: str, parts) -> None:
    """Write a file under another name and move it into place, so that tasks that run twice leave one whole file."""
    fs, at = filesystem(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    temporary = f"{at}.{os.getpid()}.{os.urandom(4).hex()}"
    with fs.open_output_stream(temporary) as out:
        for p in parts:
            out.write(p)
    fs.move(temporary, at)


def get(path: str) -> bytes:
    fs, at = filesystem(path)
    with fs.open_input_stream(at) as f:
        return f.read()


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary over the id arrays of a bounded sample of documents, cut into pieces.

    Documents are chosen by a hash of doc_id and text: a hash bound leaves somewhat over SAMPLE_DOCUMENTS of them, the smallest hashes are taken; tasks
    encode them. Pieces beyond SAMPLE_BYTES are not trained on. Where there is too little for the trainer, the pieces themselves, one
    after another, are the dictionary. It is empty only where no document has text.
    """
    n = docs.count()
    h = F.xxhash64("doc_id", "text")
    bound = -(1 << 63) + min((2 * SAMPLE_DOCUMENTS << 64) // max(n, 1), (1 << 64) - 1)
    some = docs.where("text is not null").withColumn("h", h).where(F.col("h") <= bound)

    def encode(batches):
        e = encoder(path)
        for batch in batches:
            for lo, hi, texts in text_runs(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(e.encode(texts), pa.binary())], names=["h", "ids"])

    chosen = saved(some.select("doc_id", "h").orderBy("h", "doc_id").limit(SAMPLE_DOCUMENTS), "sample")
    last = chosen.agg(F.max("h")).first()[0]
    pieces_, size = [], 0
    if last is not None:
        for r in some.where(F.col("h") <= last).select("doc_id", "h", "text").mapInArrow(encode, "h long, ids binary").orderBy("h", "ids").limit(SAMPLE_DOCUMENTS).toLocalIterator():
            parts = [bytes(r["ids"][i : i + 4 * PIECE_IDS]) for i in range(0, len(r["ids"]), 4 * PIECE_IDS)]
            for part in parts:
                if size + len(part) <= SAMPLE_BYTES:
                    pieces_.append(part)
                    size += len(part)
    return dictionary_of(pieces_)


def dictionary_of(parts: list[bytes]) -> bytes:
    """A trained dictionary, or, where the trainer has too little, the parts as they are (the last DICTIONARY_BYTES of them)."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, parts)) // 8)), [p for p in parts if len(p) >= 16]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[-DICTIONARY_BYTES:]


def write_token_files(docs: DataFrame, to: str, vocabulary: str | None = None, files: int | None = None) -> DataFrame:
    """Encode docs and write their ids, each document's with END_ID behind, in ascending doc_id order; the files' table.

    The table: file (number in doc_id order), path, documents, ids, start (ids in all files before it). Documents are encoded and
    compressed where they are read; only frames are sorted. Repeated doc_ids keep all rows, in order of a hash of their frames, and
    may go to several files, so may equal rows. A null doc_id sorts first; a null or empty text has the end id alone. An empty table gives no files.
    """
    spark = docs.sparkSession
    ship(spark)
    vocabulary = vocabulary_path(vocabulary)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, vocabulary)
    name = hashlib.sha256(dictionary).hexdigest()
    put(f"{to}/dictionary-{name}", [dictionary])
    shared = spark.sparkContext.broadcast(dictionary)

    def frames(batches):
        made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None, write_content_size=True)
        e = encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for lo, hi, texts in text_runs(batch.column(1)):
                ids = [x + end for x in e.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([made.compress(x) for x in ids], pa.binary())], names=["doc_id", "n", "frame"])

    rows = saved(docs.mapInArrow(frames, "doc_id long, n long, frame binary"), "frames")
    if files is None:
        total = rows.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
        files = max(1, total // (32 << 20))
    # a row's place in the saved files is the same whenever a task runs again; it parts equal rows
    rows = rows.select("*", F.xxhash64("frame").alias("h"), F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("salt"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("salt")]
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ordered = ordered.select(F.spark_partition_id().cast("long").alias("file"), "doc_id", "n", "frame")

    def write(batches):
        entries, number, at, start = [], None, len(MAGIC) + 32, 0

        def parts():
            nonlocal number, at, start
            yield MAGIC + bytes.fromhex(name)
            for batch in batches:
                if not batch.num_rows:
                    continue
                number = batch.column(0)[0].as_py()
                for d, n, frame in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    entries.append((NO_ID if d is None else d, at, len(frame), n, start))
                    at, start = at + len(frame), start + n
                    yield frame
            yield np.array(entries, ENTRY).tobytes()
            yield struct.pack(TAIL, at, len(entries))

        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        batches = itertools.chain([first], batches)
        path = f"{to}/ids-{first.column(0)[0].as_py():08d}"
        put(path, parts())
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([path]), pa.array([len(entries)], pa.int64()), pa.array([start], pa.int64())], names=["file", "path", "documents", "ids"])

    written = saved(ordered.mapInArrow(write, "file long, path string, documents long, ids long"), "files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


class TokenFile:
    """Read single documents of a file: the index first, then only the frames that are asked for."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        head = self.file.read(len(MAGIC) + 32)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        size = self.file.size()
        where, n = struct.unpack(TAIL, self.file.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        self.index = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, where), ENTRY)
        name = head[len(MAGIC) :].hex()
        dictionary = get(f"{os.path.dirname(path)}/dictionary-{name}")
        if hashlib.sha256(dictionary).hexdigest() != name:
            raise ValueError(f"{path}: the dictionary beside it is another one")
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        e = self.index[i]
        return np.frombuffer(self.reader.decompress(self.file.read_at(int(e["size"]), int(e["at"]))), "<u4")

    def find(self, doc_id: int) -> list[int]:
        """Places of a doc_id, by binary search."""
        a, b = np.searchsorted(self.index["doc_id"], [doc_id, doc_id], side="left"), np.searchsorted(self.index["doc_id"], doc_id, side="right")
        return list(range(int(a[0]), int(b)))

    def close(self) -> None:
        self.file.close()


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read from the files of write_token_files()'s table."""
    ship(files.sparkSession)

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(path)
                x = f.index
                crc = [zlib.crc32(f.ids(i).tobytes()) for i in range(len(x))]
                doc = pa.array(x["doc_id"], pa.int64(), mask=x["doc_id"] == NO_ID)
                yield pa.RecordBatch.from_arrays([doc, pa.array(x["start"].astype(np.int64) + start), pa.array(x["n"].astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                f.close()

    n = max(1, files.count())
    return files.select("path", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write docs' ids into the shared folder and return what read_token_files() finds there."""
    return read_token_files(saved(write_token_files(docs, shared_path(spark, "token-ids"), vocabulary), "table"))
