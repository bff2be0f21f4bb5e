"""Rows that share ids, texts or keys: nothing is lost, nothing kept twice."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from sieveline.llm import common, components, sharding, simhash

A = "the grey geese crossed the frozen lake before dawn and flew north over the hills"
B = "nobody in this town could say who had painted the tower clock green last winter"


def test_representatives_tell_rows_apart_by_id_and_text(spark):
    rows = [(1, A, "x"), (2, A, "x"), (2, B, "x"), (3, "", "y"), (3, None, "y"), (7, B, "z"), (7, B, "z"), (None, A, "n"), (None, "alone here", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string").withColumn("id", F.lit(9))
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert [g for g in got if g[1]] == [(1, A), (2, B), (None, "alone here")] and len(got) == 4
    two = spark.createDataFrame([(5, A), (5, B), (5, B)], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.representatives(two).collect()) == sorted([A, B])


def plain_fingerprint(text):
    import xxhash

    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams)
        out |= (2 * ones > len(grams)) << bit
    return out


def test_fingerprints_equal_the_definition(docs):
    for r in docs.select("text").collect():
        assert simhash.fingerprint(r["text"]) == plain_fingerprint(r["text"] or "")


def test_join_skewed_is_an_inner_join(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_HOT", 3)
    left = spark.createDataFrame([(i % 5 if i % 3 else 9, i) for i in range(60)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k <> 2")
    got = sorted(tuple(r) for r in common.join_skewed(left, right, ["k"], "n", 60).select("k", "v").collect())
    assert got == sorted(tuple(r) for r in left.where("k <> 2").collect())


def test_rows_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i % 7, i) for i in range(100)], "g string, c int, v int")
    got = common.ranked(df, "g", ["c"], ["v"], "at").collect()
    for g in "ab":
        mine = sorted((r["c"], r["v"], r["at"]) for r in got if r["g"] == g)
        assert [m[2] for m in mine] == list(range(len(mine)))


def test_components_of_stars_and_chains(spark):
    links = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (5000, 1100)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, **{i: 1000 for i in itertools.chain(range(1000, 1101), [5000])}}


def test_label_propagation_against_a_plain_count_of_cuts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"text {rng.integers(0, 60)}") for i in range(300)] + [(i, "hot") for i in range(300, 450)] + [(None, None), (5, "text 1"), (5, "text 1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = sharding.balanced_shards(sharding.document_rows(df), 4, rounds=0)
    after = sharding.balanced_shards(sharding.document_rows(df), 4)

    def cut(out):
        shards = {}
        for r in out.collect():
            shards.setdefault(r["link"], []).append(r["shard"])
        return sum(a != b for s in shards.values() for a, b in itertools.combinations(s, 2))

    assert cut(after) == sharding.cut_pairs(after).first()["cut"]
    # a shard of 114 rows cannot hold the hot text's 150, so 36 * 114 pairs have to be cut; beyond them at most two texts of five
    assert cut(after) < cut(before) / 2 and cut(after) <= 36 * 114 + 2 * 36
    assert sorted(r["count"] for r in after.groupBy("shard").count().collect()) == [113, 113, 113, 114]
