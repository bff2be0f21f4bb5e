import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from sieveline.llm import bpe, components, decontamination, disclosure, htmltext, licenses, outliers, quality, sharding, simhash, tokenfiles


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_sharding_is_balanced_and_gapless(spark, docs, empty):
    out = sharding.shard_documents(docs, shards=3).collect()
    sizes = collections.Counter(r["shard"] for r in out)
    assert len(out) == 9 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    none = next(r for r in out if r["doc_id"] == 4)
    assert (none["size"], none["text_crc32"], none["law"]) == (1, 0, "rows")
    assert len({r["shard"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_splits_only_what_must_be(spark):
    many = spark.createDataFrame([(i, "same" if i < 40 else f"pair {i // 2}") for i in range(120)], "doc_id long, text string")
    out = sharding.balanced_shards(sharding.document_rows(many), 4)
    assert sorted(r["n"] for r in out.groupBy("shard").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()) == [30] * 4
    cut = sharding.cut_pairs(out).first()
    assert cut["pairs"] == 40 * 39 / 2 + 40 and cut["cut"] <= 30 * 10 + 25 + 8


def brute_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_outlier_statistics_equal_brute_force(docs, empty):
    got = sorted((str(r["doc_id"]), *(r[c] for c in outliers.COUNTS)) for r in outliers.judge(docs).collect())
    assert got == sorted((str(r["doc_id"]), *brute_statistics(r["text"] or "")) for r in docs.collect())
    assert outliers.judge(empty).count() == 0


def test_outliers_are_rejected_and_plain_documents_kept(spark):
    rng = np.random.default_rng(1)
    plain = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 80)) + ".", "en", "s") for i in range(200)]
    odd = [(1000 + i, " ".join(f"w{x}###" for x in rng.integers(0, 5000, 80)), "en", "s") for i in range(10)]
    out = by_id(outliers.judge(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string")))
    assert not any(out[i]["kept"] for i, *_ in odd) and sum(out[i]["kept"] for i, *_ in plain) >= 198


PAGE = "<html><head><title>t</title><script>var t='</p>';</script></head><body><nav><a href=1>Menu</a></nav><div class='ad x'>Buy</div><article><h1>Head &amp; line</h1><p><b>One<br>two<p>Three  &lt;four&gt;\n five</p><div class='reader-comments'>no</div></article><footer>f</footer>"


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "plain &eacute; text"), (1, "u", PAGE), (5, "u", "<p>" + "x " * 50000)], "page_id long, url string, html string")
    out = htmltext.main_texts(pages).collect()
    assert [r["text"] for r in out][:4] == ["Head & line\n\nOne two\n\nThree <four> five", "", "", "plain é text"]
    assert all(r["n_chars"] == len(r["text"]) for r in out) and len(out) == 6 and out[5]["n_chars"] == 99999
    assert htmltext.main_texts(pages.where("false")).count() == 0


def test_licenses(docs, empty):
    out = by_id(licenses.scan(docs))
    r = out[6]
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", next(d["text"] for d in docs.collect() if d["doc_id"] == 6).translate({i: i + 32 for i in range(65, 91)}))
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (len(words), 3, 3, 11, "gpl,mit", "gpl,mit", 1.0)
    assert (out[3]["n_words"], out[3]["first_word"], out[3]["labels"], out[4]["score"]) == (0, None, "", 0.0)
    assert licenses.scan(docs).count() == 9 and licenses.scan(empty).count() == 0


def test_license_diagonals_survive_an_inserted_word(spark):
    text = licenses.TEMPLATES[1][1].replace("free of charge", "free and clear of charge").upper()
    out = licenses.scan(spark.createDataFrame([(1, "x " * 50 + text)], "doc_id long, text string")).first()
    assert out["labels"] == "mit" and 0.6 <= out["score"] < 1


def test_personal_data(docs, empty):
    out = {r["doc_id"]: r for r in disclosure.digests(disclosure.find(docs)).collect()}
    r = out[None]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 0, 1)
    assert r["base_sha256"] == hashlib.sha256(b"email:9:28,phone:32:49,ip:55:63").hexdigest()
    assert out[7]["n_card"] == 1 and out[4]["spans"] == "" and len(out) == 8
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(docs).collect()}
    assert clean[None] == "write to [EMAIL] or [PHONE] from [IP] and 300.1.1.1" and clean[4] is None
    assert disclosure.find(empty).count() == 0 and disclosure.sanitised(docs).columns == docs.columns


def test_disclosing_terms(spark):
    rows = [(i, f"the Zanzibar office of boss@corp.example.com number {i} opened") for i in range(3)] + [(10 + i, f"the other office number {i} opened today") for i in range(40)]
    out = by_id(disclosure.digests(disclosure.find(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert "term:4:12" in out[0]["spans"] and "term:13:19" not in out[0]["spans"] and out[11]["spans"] == ""


def test_a_term_of_one_document_discloses(spark):
    rows = [(0, "the Zanzibar office of boss@corp.example.com opened")] + [(10 + i, f"the other office number {i} opened today") for i in range(99)]
    out = by_id(disclosure.digests(disclosure.find(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert "term:4:12" in out[0]["spans"] and "term:13:19" not in out[0]["spans"] and out[11]["spans"] == ""


def test_disclosing_terms_go_everywhere_in_the_text(spark):
    far = "lorem ipsum " * 20
    texts = [f"Zanzibar ({far}) boss@corp.example.com {far}-Zanzibar, ÇELIK mailZanzibar zanzibar_x Bo {far}zanzibar", f"{far}boss@corp.example.com {far}"]
    rows = [*enumerate(texts), *((10 + i, f"{far} number {i}") for i in range(150))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = by_id(disclosure.sanitised(df))
    want = texts[0].replace("boss@corp.example.com", "[EMAIL]")
    want = re.sub(r"\b(zanzibar|ÇELIK|mailZanzibar|Bo)\b", "[TERM]", want, flags=re.I)
    assert out[0]["text"] == want and out[1]["text"] == texts[1].replace("boss@corp.example.com", "[EMAIL]") and out[10]["text"] == rows[2][1]
    spans = by_id(disclosure.digests(disclosure.find(df)))[0]["spans"]
    assert spans.startswith("term:0:8,") and spans.endswith(f"term:{len(texts[0]) - 8}:{len(texts[0])}")


def test_quality_learns_and_handles_odd_rows(spark, docs, empty):
    rng = np.random.default_rng(3)
    text = lambda good: " ".join(f"w{x}" + ("" if good else "###") for x in rng.integers(0, 300, 60))
    rows = [(i, text(i % 3 > 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = by_id(quality.scores(df, labels))
    held = [i for i in out if out[i]["held_out"]]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == out[i]["held_out"] for i in out)
    assert np.mean([out[i]["predicted"] == (i % 3 > 0) for i in held]) > 0.95
    odd = quality.scores(docs, labels.where("false")).collect()
    assert len(odd) == 9 and len({r["score"] for r in odd}) == 1 and quality.scores(empty, labels).count() == 0
    assert {r["doc_id"] for r in quality.accepted(df, labels).collect()} == {i for i in out if out[i]["predicted"]}


def test_bpe_and_token_files_equal_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    want = [(r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()]
    got = bpe.encode_documents(docs, with_ids=True).collect()
    for (doc, ids), r in zip(want, got, strict=True):
        assert (r["doc_id"], r["n_tokens"], r["ids"]) == (doc, len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    start, expected = 0, []
    for doc, ids in sorted(want, key=lambda x: (x[0] is not None, x[0] or 0)):
        expected.append((str(doc), start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())))
        start += len(ids) + 1
    files = tokenfiles.write_token_files(docs, tokenfiles.shared_path(spark, "t"), files=3)
    assert sorted((str(r[0]), *r[1:]) for r in tokenfiles.read_token_files(files).collect()) == sorted(expected)
    one = tokenfiles.TokenFile(files.where("documents > 0").orderBy("file").first()["path"])
    assert one.ids(0).tolist()[-1] == 1
    assert tokenfiles.token_file_digests(spark, empty).count() == 0 and bpe.encode_documents(empty).count() == 0


def test_pair_index_on_runs_of_equal_letters():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    texts = ["a" * n for n in range(1, 30)] + ["ab" * n for n in range(1, 20)] + ["é" * 7, "!?!?!", "it's 12³ ΑΣ\x1cx"]
    got = [ids for ids, _ in bpe.encoded(bpe.PairIndex(bpe.vocabulary_path()), texts)]
    assert got == [" ".join(map(str, t.encode(x, add_special_tokens=False).ids)) for x in texts]


def test_leaks(spark, docs, empty):
    passage = "the seven grey geese crossed the frozen lake before dawn and nobody in the village heard them go north"
    bench = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "fox")], "item_id long, text string")
    edited = passage.replace("grey", "gray").replace("village", "vilage").upper()
    more = spark.createDataFrame([(20, "x " * 3000 + passage + " y"), (21, f"before\n\n{edited} after"), (22, passage[:40])], "doc_id long, text string")
    out = sorted(tuple(r) for r in decontamination.leaks(docs.select("doc_id", "text").unionByName(more), bench).collect())
    assert [(d, i, e) for d, i, _, _, e, *_ in out] == [(1, 4, 0), (2, 4, 0), (2, 4, 0), (20, 1, 0), (21, 1, 2)]
    assert out[3][2:4] == (6000, 6000 + len(passage))
    assert {r["doc_id"] for r in decontamination.clean(more, bench).collect()} == {22}
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(docs, bench.where("false")).count() == 0


def reachable(fps, bits):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("rows", [2048, 16])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 30)
    fps = sorted({int(s) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 6)))) for s in seeds for _ in range(12)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.close_links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps), 4)
    root = {r["node"]: r["root"] for r in components.components(links).collect()}
    groups = collections.defaultdict(set)
    for x in signed:
        groups[root.get(x, x)].add(x)
    want = collections.defaultdict(set)
    for x, r in zip(signed, reachable(fps, 4), strict=True):
        want[r].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_of_odd_rows(docs, empty):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == 9 and {r["component_id"] for r in out if r["doc_id"] in (1, 2)} == {1}
    assert {r["component_id"] for r in out if r["doc_id"] in (3, 4)} == {3} and {r["fp"] for r in out if r["doc_id"] in (3, 4)} == {0}
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns or set(kept.columns) == set(docs.columns)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "5", "6", "7", "None"]
    assert simhash.near_duplicates(empty).count() == 0
