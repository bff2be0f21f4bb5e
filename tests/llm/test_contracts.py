"""The SQL of the operators' contract columns, and the whole pipeline on a small corpus with odd rows."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import bpe, contracts

DIR = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(v).removesuffix(".0").replace("<NA>", "nan") for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(contracts.QUERIES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    mine, theirs = contracts.QUERIES[name](spark, DIR).toPandas(), c.execute(contracts.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and rows(mine) == rows(theirs)


def test_the_pipeline_keeps_what_it_should(spark, tmp_path):
    r = np.random.default_rng(12)
    words = ["".join(r.choice(list("abcdefghijklmno"), 5)) for _ in range(900)]
    prose = lambda n=60: " ".join(r.choice(words, n)) + "."
    passage = " ".join(r.choice(words, 24))
    docs = [(i, prose()) for i in range(300)] + [(1000 + i, " ".join(f"{w}###$$$" for w in r.choice(words, 60))) for i in range(150)]
    copy = prose(80)
    docs += [(2000, copy), (2001, copy), (2001, copy), (2002, copy + " indeed"), (2001, prose(70)), (2003, prose() + " " + passage + " " + prose()), (2004, prose() + " mail boss@corp.example.com"), (None, prose()), (2005, None), (2006, ""), (2007, prose(4000))]
    df = spark.createDataFrame([(i, t, None if k % 7 == 0 else "en", "s", len(t or "")) for k, (i, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in docs if i is not None and i < 2000], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage, kept = df, {}
    for name, step in corpus_pipeline.STAGES[:4]:
        stage = step(spark, stage, str(tmp_path))
        assert stage.columns == df.columns
        stage = spark.createDataFrame(stage.collect(), df.schema)
        kept[name] = sorted((-1 if x["doc_id"] is None else x["doc_id"], x["text"] or "") for x in stage.collect())
    first = kept["quality classifier"]
    assert [d for d, _ in first if 1000 <= d < 2000] == [] and len([d for d, _ in first if 0 <= d < 300]) >= 295
    assert {2000, 2001, 2002, 2003, 2004, 2007, -1} <= {d for d, _ in first}
    near = kept["simhash near-dedup"]
    assert (2000, copy) in near and (2001, copy) not in near and [d for d, _ in near].count(2001) == 1
    assert len(near) == len({t for _, t in near}) and {d for d, _ in first} - {d for d, _ in near} <= {2002, 2006}
    clean = kept["benchmark decontamination"]
    assert [x for x in near if x not in clean] == [x for x in near if x[0] == 2003]
    private = dict(kept["pii"])
    assert "boss@" not in private[2004] and "[EMAIL]" in private[2004]
    assert {d: t for d, t in clean if d != 2004} == {d: t for d, t in private.items() if d != 2004}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = sorted((d, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()) for d, text in kept["pii"] for e in [t.encode(text, add_special_tokens=False).ids])
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_tokens"], x["ids_sha256"]) for x in out) == want
    assert [x["n_chars"] for x in stage.where(F.col("doc_id") == 2004).collect()] == [len(private[2004])]


def test_the_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
