"""Collocations: phrases that are more frequent than their parts suggest, from exact counts of all word n-grams.

Equal pieces of text become one row with a multiplicity, so copies are counted without being read again. Each task turns its pieces into weighted n-grams; these
are dealt out by their hash, and duckdb adds up each bucket, on disk where memory is short. A candidate asks for the counts of its parts by requests that are
shuffled to where the parts' counts lie.
"""

from __future__ import annotations

import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import releasing, saved, ship, small
from sieveline.llm.textarrays import distinct, hashes, mixed, numbered, slices, tokens

LONGEST, LEAST, TOP = 4, 30, 2000
#: A phrase goes if a longer candidate holds it and has this share of its count, in hundredths.
COVER = 80
#: What the score is multiplied by, so that it is a whole number.
SCALE = 2_000_000
#: Memory that duckdb may use in a task before it goes to disk.
COUNTER_MEMORY = "256MB"
#: Bits for each frequent pair in the map that longer phrases are looked up in, and the map's bytes at least and at most (powers of two).
MAP_BITS, LEAST_MAP, MOST_MAP = 16, 1 << 16, 1 << 28
#: Bytes of pieces that a bucket's n-grams come from, and buckets at least. A task sends a row for each bucket, language and n-gram size, or fewer.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 64
NO_LANGUAGE = "und"
_SEPARATORS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")
_SPACE = np.ones(256, np.uint8)
_SPACE[32] = 0
#: Text whose pieces, and pieces whose n-grams, a task adds up together.
TEXT_BYTES, GRAM_BYTES = 2 << 20, 4 << 20


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, m: every distinct piece of text of a language, its words parted by one space, and how often it stands in the documents."""

    def each(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, data, rows in slices(batch.column(1), TEXT_BYTES):
                view, by = data.tobytes(), {}
                for lang, a, b in zip(langs[lo:hi], rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                    by.setdefault(lang, []).append(view[a:b])
                for lang, texts in by.items():  # no piece goes over the end of a text
                    counts = Counter(b" ".join(p.split()) for p in b"\n".join(texts).lower().translate(_SEPARATORS).split(b"\n"))
                    counts.pop(b"", None)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "piece", "m"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), "text")
    return rows.mapInArrow(releasing(each), "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _folded(h: np.ndarray, seeds: np.ndarray, at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on and of the group's seed, from the words' hashes."""
    out = mixed(seeds[row[at]] + h[at])
    for i in range(1, n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[at + i])
    return out


def weighted_grams(data: np.ndarray, rows: np.ndarray, group: np.ndarray, weight: np.ndarray, sizes: range, seeds: np.ndarray, seen: np.ndarray | None):
    """(words, group, start, end, weight, hash) of all n-grams of the rows, those equal in one group as one; words are parted by single spaces.

    n-grams come in the order of their words' numbers, so those that begin alike stand together. A hash depends on the words and the group's seed alone. Where seen,
    a bit map of hashes, is given, n-grams with a pair of words that it lacks are left out.
    """
    starts, ends, row = tokens(data, rows, _SPACE)
    if not len(starts):
        return
    first, word = distinct(data, starts, ends)
    h = hashes(data, starts[first], ends[first])[word]
    of, seeds = group[row], seeds[group]
    pair = None
    if seen is not None:
        at = np.flatnonzero(row[:-1] == row[1:])
        bit = _folded(h, seeds, at, row, 2) & np.uint64(8 * len(seen) - 1)
        pair = np.zeros(len(word), bool)
        pair[at] = seen[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
    for n in sizes:
        ok = row[: len(row) - n + 1] == row[n - 1 :]
        for i in range(n - 1 if pair is not None else 0):
            ok &= pair[i : len(ok) + i]
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        code = numbered(of[at], *(word[at + i] for i in range(n)))
        total = np.zeros(int(code.max()) + 1, np.int64)
        np.add.at(total, code, weight[row[at]])
        one = np.empty(len(total), np.int64)
        one[code] = np.arange(len(at))
        place = at[one]
        yield n, of[place], starts[place], ends[place + n - 1], total, _folded(h, seeds, place, row, n)


def _packed(phrases: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the phrases one after another, each with a line end behind it."""
    starts, size = starts[phrases], (ends - starts)[phrases] + 1
    at = np.cumsum(size)
    flat = np.append(data, np.uint8(10))[np.minimum(np.repeat(starts - at + size, size) + np.arange(int(at[-1])), len(data))]
    flat[at - 1] = 10
    return flat


def _gathered(batches, most: int):
    """Batches of about most bytes, made of smaller ones."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some, size = [], 0
    if size:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def grams(some: DataFrame, buckets: int, sizes: range, seen=None) -> DataFrame:
    """bucket, lang, phrases, weights: the weighted n-grams of the pieces, added up as far as a task meets them together, parted by their hash.

    phrases has many n-grams, one a line, weights as many 64-bit numbers, both compressed: they would fill the disk of a shuffle one by one. An empty
    phrase has the number of all words of the language, where sizes begins with 1. seen is a broadcast bit map of pairs, as weighted_grams() takes it.
    """

    def each(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in _gathered(batches, GRAM_BYTES):
            for lo, hi, data, rows in slices(batch.column(1), GRAM_BYTES):
                names, group = {}, []
                for lang in batch.column(0).slice(lo, hi - lo).to_pylist():
                    group.append(names.setdefault(lang, len(names)))
                seeds = np.array([_seed(x) for x in names], np.uint64)
                weight = batch.column(2).slice(lo, hi - lo).to_numpy()
                out = []
                all_words = np.zeros(len(names), np.int64)
                for n, of, start, end, total, h in weighted_grams(data, rows, np.array(group), weight, sizes, seeds, None if seen is None else np.frombuffer(seen.value, np.uint8)):
                    if n == 1:
                        np.add.at(all_words, of, total)
                    cell = (h % np.uint64(buckets)).astype(np.int64) * len(names) + of
                    order = np.argsort(cell, kind="stable")
                    cuts = np.flatnonzero(np.diff(cell[order], prepend=-1))
                    ends = np.append(cuts[1:], len(order))
                    flat = _packed(order, data, start, end)
                    at = np.append(0, np.cumsum((end - start)[order] + 1))
                    for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
                        bucket, lang = divmod(int(cell[order[a]]), len(names))
                        out.append((bucket, lang, pack.compress(flat[at[a] : at[b]].tobytes()), pack.compress(total[order[a:b]].tobytes())))
                out += [(int(seeds[i] % np.uint64(buckets)), i, pack.compress(b"\n"), pack.compress(all_words[i : i + 1].tobytes())) for i in range(len(names) if sizes[0] == 1 else 0)]
                lang = pa.array(list(names), pa.string()).take(pa.array([o[1] for o in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), lang, pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.binary())], names=["bucket", "lang", "phrases", "weights"])

    return some.mapInArrow(releasing(each), "bucket int, lang string, phrases binary, weights binary")


def counted(some: DataFrame, buckets: int, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, f of the n-grams that some, a table of grams(), holds at least so often; the empty phrase, of no words, always stays.

    Each bucket is a task, which counts in a duckdb database of its own; that spills into the task's temporary folder and is removed with it.
    """
    lines = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def each(batches):
        import duckdb

        unpack = zstandard.ZstdDecompressor()

        def rows():
            for batch in batches:
                for lang, phrases, weights in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    raw, f = np.frombuffer(unpack.decompress(phrases), np.uint8), np.frombuffer(unpack.decompress(weights), np.int64)
                    ends = np.append(0, np.flatnonzero(raw == 10) + 1).astype(np.int32)
                    phrase = pa.StringArray.from_buffers(len(f), pa.py_buffer(ends), pa.py_buffer(raw))
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(f), np.int64))), phrase, pa.array(f)], schema=lines)

        with tempfile.TemporaryDirectory(prefix="sieveline-count-") as folder:
            with duckdb.connect(config={"memory_limit": COUNTER_MEMORY, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False}) as db:
                db.register("grams", pa.RecordBatchReader.from_batches(lines, rows()))
                db.execute(f"SELECT lang, phrase[:-2], sum(f)::BIGINT FROM grams GROUP BY lang, phrase HAVING phrase = chr(10) OR sum(f) >= {int(least)}")
                while found := db.fetchmany(20_000):
                    lang, phrase, f = zip(*found, strict=True)
                    words = [p.count(" ") + 1 if p else 0 for p in phrase]
                    yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(words, pa.int32()), pa.array(phrase, pa.string()), pa.array(f, pa.int64())], names=["lang", "words", "phrase", "f"])

    return some.repartitionById(buckets, "bucket").mapInArrow(releasing(each), "lang string, words int, phrase string, f long")


def pair_map(pairs: DataFrame):
    """A broadcast bit map of the pairs of words of pairs(lang, phrase): MAP_BITS bits for each, between the sizes of LEAST_MAP and MOST_MAP bytes.

    A bit may stand for several pairs, so the map may let through what it need not, and lets through all once it is full, but never lacks one of the pairs. Tasks
    make parts of it, which are put together by their place; the driver holds one map.
    """
    spark = pairs.sparkSession
    size = min(MOST_MAP, max(LEAST_MAP, 1 << (pairs.count() * MAP_BITS // 8).bit_length()))

    def parts(batches):
        for batch in batches:
            seeds = np.array([_seed(x) for x in batch.column(0).to_pylist()], np.uint64)
            for lo, hi, data, rows in slices(batch.column(1), GRAM_BYTES):
                starts, ends, row = tokens(data, rows, _SPACE)
                at = np.arange(0, len(starts), 2)
                bit = np.unique(_folded(hashes(data, starts, ends), seeds[lo:hi], at, row, 2) & np.uint64(8 * size - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bit // (8 * LEAST_MAP)), pa.array(bit % (8 * LEAST_MAP))], names=["part", "bit"])

    def joined(key, batch):
        out = np.zeros(8 * LEAST_MAP, bool)
        out[batch.column("bit").to_numpy()] = True
        return pa.table({"part": [key[0].as_py()], "bits": [np.packbits(out, bitorder="little").tobytes()]})

    made = pairs.select("lang", "phrase").mapInArrow(releasing(parts), "part long, bit long").distinct().groupBy("part").applyInArrow(joined, "part long, bits binary")
    out = np.zeros(size, np.uint8)
    for r in made.toLocalIterator():
        out[r["part"] * LEAST_MAP : (r["part"] + 1) * LEAST_MAP] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(out.tobytes())


def gram_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, f: all phrases of up to longest words that stand at least so often within pieces; words 0 has each language's number of words.

    Words and pairs are counted first. A longer phrase stands no more often than any pair in it, so only those whose pairs all stand often enough are counted then.
    """
    spark = docs.sparkSession
    ship(spark)
    some = saved(pieces(docs), "pieces")
    size = some.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    short = saved(counted(grams(some, buckets, range(1, min(longest, 2) + 1)), buckets, least), "short-phrases")
    if longest < 3:
        return short
    seen = pair_map(short.where("words = 2"))
    return short.unionByName(counted(grams(some, buckets, range(3, longest + 1), seen), buckets, least))


def _words(phrase, start, n):
    """n words of a phrase from its start-th (from 0) on."""
    return F.array_join(F.slice(F.split(phrase, " "), start + F.lit(1), n), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language.

    Texts are lower-cased (A-Z) and split at sentence marks and line ends into pieces, these at spaces and tabs into words. Candidates are phrases of 2 to longest
    words that stand a >= least times. A candidate's score is that of its weakest cut into a first part (l times) and a rest (r times). Candidates
    inside a longer candidate that has cover hundredths of their count go. n is the number of words of the language. A null lang is und, a null text is empty;
    repeated rows count each; columns beyond lang and text are not read; an empty table gives no rows.
    """
    counts = saved(gram_counts(docs, longest, least), "phrase-counts")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    longer = candidates.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("from", F.explode(F.sequence(F.lit(0), F.col("words") - F.col("size"))))
    inside = longer.groupBy("lang", _words(F.col("phrase"), F.col("from"), F.col("size")).alias("phrase")).agg(F.max("a").alias("most"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(F.expr(f"most IS NULL OR cast(most AS decimal(20,0)) * 100 < cast(a AS decimal(20,0)) * {int(cover)}")).drop("most")
    # requests for the counts of parts, answered where these lie
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    asked = F.explode(F.array(F.struct(F.lit(True).alias("head"), _words(F.col("phrase"), F.lit(0), F.col("k")).alias("part")), F.struct(F.lit(False).alias("head"), _words(F.col("phrase"), F.col("k"), F.col("words") - F.col("k")).alias("part"))))
    requests = cuts.withColumn("asked", asked).select("lang", "phrase", "a", "k", "asked.head", "asked.part")
    answers = requests.join(counts.where("words > 0").select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    of = lambda k, head: F.max(F.when((F.col("k") == k) & (F.col("head") == head), F.col("f")))
    parts = answers.groupBy("lang", "phrase", "a").agg(*(of(k, head).alias(f"{side}{k}") for k in range(1, longest) for side, head in (("l", True), ("r", False))))
    scored = F.array_min(F.filter(F.array(*(F.expr(f"CASE WHEN l{k} IS NOT NULL THEN struct((cast(a AS decimal(20,0)) * cast({SCALE} AS decimal(8,0))) div cast(l{k} + r{k} AS decimal(20,0)) AS score, {k} AS k, l{k} AS l, r{k} AS r) END") for k in range(1, longest))), lambda x: x.isNotNull()))
    best = parts.withColumn("cut", scored).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return first.join(small(n, 100_000), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same result for the tables of a check, without any of the steps above.
ORACLE = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), gram AS (
  SELECT lang, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT lang, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM piece, generate_series(1, 4) AS g(n))
), f AS (
  SELECT lang, n, phrase, count(*)::HUGEINT AS f FROM gram GROUP BY ALL HAVING count(*) >= 30
), cand AS (
  SELECT lang, n, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE n > 1
), held AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(generate_series(1, n - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, n - 1)) AS m FROM cand)) GROUP BY ALL
), kept AS (
  SELECT c.* FROM cand c LEFT JOIN held h USING (lang, phrase) WHERE h.most IS NULL OR 100 * h.most < 80 * c.a
), cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:n], ' ') AS tail FROM (SELECT *, unnest(generate_series(1, n - 1)) AS k FROM kept)
), scored AS (
  SELECT cut.*, l.f AS l, r.f AS r, (2000000 * a) // (l.f + r.f) AS score FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = head JOIN f r ON r.lang = cut.lang AND r.phrase = tail
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM placed JOIN (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
