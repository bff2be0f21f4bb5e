"""License labels against a plain scan of words, word by word."""

import random
import re

from pyspark.sql import functions as F

from sieveline.llm import licenses as s


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain_edits(template, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(template, 1):
        left, diagonal = i, row[0]
        row[0] = i
        for j, x in enumerate(text, 1):
            cell = min(diagonal + (w != x), row[j] + 1, left + 1)
            diagonal, row[j], left = row[j], cell, cell
    return min(row)


def plain_scan(text):
    w = words(text)
    places = sorted((i, label) for p, label in s.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    base = {label for _, label in places}
    own = {}
    for label, t in s.TEMPLATES:
        t = words(t)
        edits = plain_edits(t, w)
        if edits <= int(s.EDITS * len(t)):
            own[label] = max(own.get(label, 0), 1 - edits / len(t))
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | set(own))), max([0.5 if base else 0.0, *own.values()])


def test_labels_equal_a_plain_scan(spark):
    r = random.Random(9)
    vocabulary = "the of software license public granted without under and river stone".split()
    texts = [None, "", "mit license", "MIT  License, apache-license\nGENERAL PUBLIC LICENSE mit license"]
    for _ in range(60):
        before, after = (" ".join(r.choices(vocabulary, k=r.randint(0, 40))) for _ in "ab")
        t = r.choice(s.TEMPLATES)[1].split(" ")
        for _ in range(r.randint(0, max(1, int(len(t) * 0.06)))):
            at = r.randrange(len(t))
            t[at : at + 1] = r.choice([[], ["changed"], [t[at], "added"]])
        texts.append(r.choice([before, f"{before} {' '.join(t)} {after}", f"{before} {' '.join(t).upper()}\n\n{after} {' '.join(t)}"]))
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("th", "id", "label", "template")})
    got = sorted((str(x["doc_id"]), x["n_words"], x["n_base"], str(x["first_word"]), str(x["last_word"]), x["base_labels"], x["labels"], round(x["score"], 9)) for x in s.scan(df).collect())
    want = sorted((str(i if i % 7 else None), *(str(v) if k in (2, 3) else round(v, 9) if k == 6 else v for k, v in enumerate(plain_scan(t)))) for i, t in enumerate(texts))
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not wrong and sum("," in w[6] or w[6] != "" for w in want) > 30
