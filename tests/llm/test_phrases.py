"""Collocations against a plain count, on made tables with odd rows and on the given ones against SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from sieveline.llm import phrases
from sieveline.llm.queries import op13_phrase_collocations


def plain(rows, least=30, cover=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, w[i : i + size]) for (lang, w), a in cand.items() for size in range(2, len(w)) for i in range(len(w) - size + 1) if 100 * a >= cover * f[lang, w[i : i + size]]}
    out = []
    for lang in n:
        found = []
        for (other, w), a in cand.items():
            if other == lang and (lang, w) not in gone:
                score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
                found.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(rng, n):
    words = ["New", "york", "ÉTÉ", "the", "of", "a", "mayor\x1c", "<b>", "x"]
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ", \n", "\x0c", ":", "  "]) for _ in range(rng.randrange(60)))
        yield rng.choice(["en", "en", "fr", None]), text if rng.random() > 0.1 else rng.choice(["", None, "New York of the mayor", "New York of the mayor"])


def test_collocations_against_a_plain_count(spark, empty, monkeypatch):
    rng = random.Random(13)
    rows = [*rows_of(rng, 400), ("de", None), ("de", " .. "), ("xx", "one two " * 40)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, words int, f int").repartition(3)
    for least, cover, top in ((30, 80, 2000), (3, 50, 7)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least=least, cover=cover, top=top).collect())
        assert got == plain(rows, least, cover, top) and got
    monkeypatch.setattr(phrases, "TEXT_BYTES", 100)
    monkeypatch.setattr(phrases, "GRAM_BYTES", 100)
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == plain(rows)
    assert phrases.collocations(empty).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a = 9 * 10**15
    got = spark.sql(f"SELECT (cast({a}L AS decimal(20,0)) * cast({phrases.SCALE} AS decimal(8,0))) div cast({2 * a + 1}L AS decimal(20,0)) AS s").first()[0]
    assert got == phrases.SCALE * a // (2 * a + 1) and phrases.SCALE * a > 1 << 63


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_the_given_tables_against_sql(spark, sf):
    at = f"/root/testdata/{sf}"
    ours = op13_phrase_collocations(spark, at)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    found = db.execute(phrases.ORACLE)
    columns = [c[0] for c in found.description]
    assert ours.columns == columns
    assert sorted(tuple(r) for r in ours.collect()) == sorted(found.fetchall())
