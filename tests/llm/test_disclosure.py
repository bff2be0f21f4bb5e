"""Personal data against a plain version: places, disclosing terms, replacements, hot keys, clashing names, long texts."""

import collections
import math
import random
import re

from pyspark.sql import functions as F

from sieveline.llm import common, disclosure

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_base(text):
    out = []
    for o, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), o, kind, m.end(), m[0]))
    return sorted(out)


def plain_find(rows):
    """(base, terms) of each text: the module's rule with dictionaries and loops."""
    n = len(rows)
    base = [plain_base(t or "") for _, t in rows]
    words = [{w.lower() for w in re.findall(r"(?<!\w)[^\W\d_]+(?!\w)", t or "")} for _, t in rows]
    values = [{f"{s[2]}:{s[4].lower()}" for s in b} for b in base]
    df_term, df_value, both = collections.Counter(), collections.Counter(), collections.Counter()
    for w, v in zip(words, values, strict=True):
        df_term.update(w)
        df_value.update(v)
        both.update((e, t) for e in v for t in w)
    shown = set()
    for (e, t), c in both.items():
        if df_value[e] < n and math.log2(c * n / (df_value[e] * (df_term[t] + 0.5))) >= 0.9 * math.log2(n / df_value[e]):
            shown.add((e, t))
    out = []
    for (_, text), b, v in zip(rows, base, values, strict=True):
        terms = [(m.start(), 4, "term", m.end(), m[0].lower()) for m in re.finditer(r"(?<!\w)[^\W\d_]+(?!\w)", text or "") if any((e, m[0].lower()) in shown for e in v)]
        out.append((b, terms))
    return out


def plain_text(text, spans):
    out, at = "", 0
    for s in sorted(spans):
        if s[0] >= at:
            out += text[at : s[0]] + disclosure.GENERAL[s[2]]
        at = max(at, s[3])
    return out + text[at:]


def corpus():
    r = random.Random(7)
    common_words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(160):
        words = r.choices(common_words, k=r.randint(0, 40))
        if i % 3 == 0:
            words.insert(r.randint(0, len(words)), "hot@all.example.com")
        if i % 8 == 0:
            value = r.choice(["boss@corp.example.com", "+1 (017) 555-7713", "10.0.0.1", "4845168114407329", f"u{i % 5}@x.org"])
            words += ["Zanzibar" if "boss" in value else f"Ünique{value[1:3]}".replace(".", "x"), value, r.choice(["x9office office", "office-boss"])]
            r.shuffle(words)
        rows.append((i if i % 50 else None, ("-" if i % 11 == 0 else r.choice([" ", ", ", "\n"])).join(words)))
    return [*rows, (7, None), (8, ""), (9, rows[8][1]), (9, rows[8][1])]


def test_spans_terms_and_texts_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_HOT", 20)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_find(rows)
    assert any(t for _, t in want) and any("hot@" in s[4] for b, _ in want for s in b)
    tuples = lambda spans: [(s["start"], s["ord"], s["kind"], s["stop"], s["value"]) for s in spans]
    got = sorted((str(r["doc_id"]), tuples(r["base"]), tuples(r["terms"])) for r in disclosure.find(df).collect())
    assert got == sorted((str(i), b, t) for (i, _), (b, t) in zip(rows, want, strict=True))
    clash = df.withColumns({c: F.lit(c) for c in ("k", "base", "terms", "_s", "_th", "_d", "_t", "at", "part")})
    clean = disclosure.sanitised(clash)
    assert clean.columns == clash.columns
    texts = sorted((str(r["doc_id"]), str(r["text"]), r["k"], r["_s"]) for r in clean.collect())
    assert texts == sorted((str(i), str(t if t is None else plain_text(t, b + w)), "k", "_s") for (i, t), (b, w) in zip(rows, want, strict=True))


def test_places_come_from_the_matches(spark):
    text = "a x9office office boss@corp.example.com"
    rows = [(0, text)] + [(10 + i, f"a number {i} boss") for i in range(99)]
    r = next(r for r in disclosure.digests(disclosure.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect() if r["doc_id"] == 0)
    assert r["spans"] == "term:11:17,email:18:39,term:23:27,term:28:35,term:36:39"


def test_many_spans_in_a_long_text(spark):
    text = "é " + " ".join(f"a{i}@b.c +1 (017) 555-{1000 + i} x" for i in range(6000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    base = plain_base(text)
    got = disclosure.find(df).first()
    assert [(s["start"], s["stop"]) for s in got["base"]] == [(s[0], s[3]) for s in base]
    assert disclosure.sanitised(df).first()["text"] == plain_text(text, base)
    assert disclosure.sanitised(df.where("false")).count() == 0


def test_a_list_of_addresses_makes_few_pairs(spark, monkeypatch):
    made = {}
    plain = disclosure.saved
    monkeypatch.setattr(disclosure, "saved", lambda df, name="step": made.setdefault(name, plain(df, name)))
    listed = " ".join(f"person{chr(97 + i % 26)}{''.join(chr(97 + int(c)) for c in str(i))} p{i}@example.com" for i in range(20_000))
    rows = [(1, listed), (2, listed + " and more"), (3, listed)] + [(i, f"plain words number {i % 7} here") for i in range(10, 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in disclosure.find(df).select("doc_id", F.size("base").alias("base"), F.size("terms").alias("terms")).collect()}
    assert found[1]["base"] == found[2]["base"] == 20_000 and found[1]["terms"] >= 20_000 and found[2]["terms"] >= 20_000
    assert made["pairs"].count() < 100
