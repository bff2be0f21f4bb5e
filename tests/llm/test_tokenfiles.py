"""The dictionary path of token-id files, hot and null ids, and reading one document."""

import os
import zlib

import numpy as np
from pyspark.sql import functions as F

from sieveline.llm import bpe, tokenfiles


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


def written(spark, df, files):
    to = tokenfiles.shared_path(spark, "t")
    return tokenfiles.write_token_files(df, to, files=files), to.removeprefix("file://")


def test_a_trained_dictionary_is_used_and_single_documents_are_read(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(900)]
    files, to = written(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), 3)
    name = next(f for f in os.listdir(to) if f.startswith("dictionary-"))
    with open(f"{to}/{name}", "rb") as f:
        assert f.read(4) == b"\x37\xa4\x30\xec"  # a trained dictionary begins with this number
    t = library()
    got = {r["doc_id"]: r for r in tokenfiles.read_token_files(files).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    table = files.orderBy("file").collect()
    one = tokenfiles.TokenFile(table[1]["path"])
    doc = int(one.index["doc_id"][5])
    assert one.find(doc) == [5] and one.find(-7) == [] and one.ids(5).tolist() == [*t.encode(texts[doc], add_special_tokens=False).ids, 1]
    one.close()


def test_a_sample_too_small_to_train_on_is_the_dictionary():
    assert tokenfiles.dictionary_of([]) == b"" and tokenfiles.dictionary_of([b"abcd" * 8]) == b"abcd" * 8


def test_equal_and_null_ids_go_to_several_files(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.lit(5)).cast("long").alias("doc_id"), F.lit("same words here").alias("text"), F.lit(1).alias("h"), F.lit(2).alias("salt"))
    files, _ = written(spark, df.union(df.where("doc_id is null").limit(0)), 4)
    rows = tokenfiles.read_token_files(files).collect()
    n = len(library().encode("same words here", add_special_tokens=False).ids) + 1
    assert files.where("documents > 0").count() > 2
    assert sorted(r["start"] for r in rows) == [i * n for i in range(400)]
    assert all(r["doc_id"] is None for r in rows if r["start"] < 200 * n) and all(r["doc_id"] == 5 for r in rows if r["start"] >= 200 * n)
