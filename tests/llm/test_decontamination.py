"""Benchmark passages against a plain edit-distance scan; common lead-ins; parts of passages; odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from sieveline.llm import decontamination as d


def plain_best(passage, text):
    """The least edits of passage at any place of text (Sellers' table)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        left, diagonal = i, row[0]
        row[0] = i
        for j, x in enumerate(text, 1):
            cell = min(diagonal + (c != x), row[j] + 1, left + 1)
            diagonal, row[j], left = row[j], cell, cell
    return min(row)


def edited(r, text, n):
    for _ in range(n):
        at = r.randrange(len(text))
        text = text[:at] + r.choice(["", "q", text[at] + "z"]) + text[at + 1 :]
    return text


def cases():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    lead = "which of the following statements about "
    items = [(i, lead + " ".join(word() for _ in range(r.randint(4, 14)))) for i in range(60)]
    texts = []
    for i in range(90):
        body = " ".join(word() for _ in range(30))
        p = r.choice(items)[1]
        n = d.budget(len(d.cut(p)[0][1])) + r.randint(-3, 2)
        texts.append(r.choice([body, lead + body, f"{body} {edited(r, p, max(n, 0))} {body}", f"{lead * 3}{edited(r, p, max(n, 0))}"]))
    return items, texts


def test_found_passages_are_those_of_a_plain_scan(monkeypatch):
    items, texts = cases()
    whole = [(i, t) for i, t in items if len(t) <= d.PIECE]
    want = {(row, i) for row, text in enumerate(texts) for i, p in whole if plain_best(p, text) <= d.budget(len(p))}
    for common, hits in ((64, 1 << 21), (2, 50)):
        monkeypatch.setattr(d, "COMMON", common)
        monkeypatch.setattr(d, "HITS", hits)
        found = d.matches(d.PassageIndex(whole), [d.normal(t) for t in texts])
        assert {(row, i) for row, i, *_ in found} == want and len(want) > 20
        for row, i, start, end, edits in found:
            assert edits == plain_best(dict(whole)[i], d.normal(texts[row])) and abs(end - start - len(dict(whole)[i])) <= edits


def test_a_common_lead_in_costs_little_memory():
    import tracemalloc

    r = random.Random(5)
    lead = "which of the following statements is true about "
    items = [(i, lead + "".join(r.choices("abcdefghij ", k=90))) for i in range(3000)]
    index = d.PassageIndex(items)
    text = d.normal(lead * 2500 + items[7][1] + lead * 100)
    tracemalloc.start()
    found = d.matches(index, [text])
    assert tracemalloc.get_traced_memory()[1] < 200 << 20 and [f[1] for f in found] == [7]
    tracemalloc.stop()


def test_parts_of_long_passages_are_found(spark, monkeypatch):
    r = np.random.default_rng(8)
    words = ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(300)]
    long = " ".join(words[:100])
    bench = spark.createDataFrame([(1, long), (1, long), (2, long), (3, " ".join(words[100:180])), (None, " ".join(words[200:215]))], "item_id long, text string")
    docs = [(10, f"x {long[200:470]} y", "a"), (11, f"x {long[200:300]} y", "b"), (12, long, "c"), (12, long, "c"), (12, "another text", "c"), (None, " ".join(words[200:215]), "d"), (13, None, "e"), (14, "", "f")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _id string").withColumns({"th": F.lit(1), "id": F.lit(2), "none": F.lit(3)})
    monkeypatch.setattr(d, "PASS_CHARS", 300)
    got = sorted(((x["doc_id"], x["item_id"], x["n_pieces"], x["of"], x["edits"]) for x in d.leaks(df, bench).collect()), key=str)
    whole = len(d.cut(long))
    few = next(g[2] for g in got if g[0] == 10)
    assert 1 <= few < whole
    assert got == sorted([(10, 1, few, whole, 0), (10, 2, few, whole, 0), *[(12, i, whole, whole, 0) for i in (1, 1, 2, 2)], (None, None, 1, 1, 0)], key=str)
    kept = d.clean(df, bench)
    assert kept.columns == df.columns and sorted((str(x["doc_id"]), x["_id"]) for x in kept.collect()) == [("11", "b"), ("12", "c"), ("13", "e"), ("14", "f")]
    assert d.clean(df.where("false"), bench).count() == 0 and d.clean(df, bench.where("false")).count() == 8
