"""Information-theoretic sanitisation of personal data, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import free_names, join_skewed, saved

#: A term discloses a value by how much of its information it carries: PMI / IC at least DISCLOSED, however few documents hold the pair.
#: PRIOR documents without the value are added to those that hold the term (the half count of Jeffreys' prior).
DISCLOSED, PRIOR = 0.9, 0.5
KINDS = ("email", "ip", "card", "phone")
#: The patterns of op5's contract. Possessive loops and the look-behind give the same matches and never step back.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
#: A text is runs of word characters and runs of others, by turns; a term is a run of letters alone.
_RUNS = r"[\p{L}\p{N}_]++|[^\p{L}\p{N}_]++"
_TERM = r"(?<![\p{L}\p{N}_])\p{L}++(?![\p{L}\p{N}_])"
_LETTERS = r"^\p{L}+$"
_SPANS = "array<struct<start:int,ord:int,kind:string,stop:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the sum over the digits from the right, every second one doubled and its digits added, is a multiple of ten."""
    each = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut(values: Column, width: Column) -> Column:
    """values in runs of width; none has none."""
    n = F.size(values)
    some = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), width), lambda i: F.slice(values, i, width))
    return F.filter(some, lambda r: F.size(r) > 0)


def _width(values: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))


def running(values: Column, together) -> Column:
    """values[0], together(values[0], values[1]), ... of an int array; together is a sum or a maximum.

    Built in runs of the array's square root: appending entry by entry to one array would cost the square of its length.
    """
    none = F.array().cast("array<int>")

    def fold(some: Column) -> Column:
        add = lambda all_, x: F.concat(all_, F.array(F.when(F.size(all_) == 0, x).otherwise(together(F.element_at(all_, -1), x))))
        return F.aggregate(some, none, add)

    def joined(inner: Column) -> Column:
        return let(fold(F.transform(inner, lambda r: F.element_at(r, -1))), lambda ends: F.flatten(F.transform(inner, lambda r, i: F.when(i == 0, r).otherwise(F.transform(r, lambda x: together(F.get(ends, i - 1), x))))))

    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(let(F.transform(_cut(v, _width(v)), fold), joined)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, value>> of all matches, in order, by code points.

    The text is parted at the matches, so a match ends after all parts and matches up to it: places come from the matches
    themselves, in time that hardly grows faster than their number.
    """
    def placed(found: Column) -> Column:
        parts = F.slice(F.split(text, pattern), 1, F.size(found))
        ends = running(F.zip_with(parts, found, lambda p, m: F.length(p) + F.length(m)), _sum)
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("stop"), m.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """array<struct<start, ord, kind, stop, value>> of the valid matches of all kinds, by start, then kind as listed."""
    def of(i: int, kind: str) -> Column:
        some = F.filter(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda m: _valid(kind, m))
        good = F.filter(located(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("ord"), F.lit(kind).alias("kind"), m["stop"].alias("stop"), m["value"].alias("value")))
        return F.when(F.size(some) > 0, spans).otherwise(_none())

    return F.array_sort(F.concat(*(of(i, kind) for i, kind in enumerate(KINDS))))


def _has(text: Column) -> Column:
    """Cheap sign that a text can hold a span: an @, or a digit."""
    return F.contains(text, F.lit("@")) | text.rlike("[0-9]")


def _none() -> Column:
    return F.array().cast(_SPANS)


def spanned(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs (null texts are empty), base, and k, which is equal for rows equal in doc_id and text only."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("base", F.when(_has(F.col("text")), base_spans(F.col("text"))).otherwise(_none()))
    return rows.withColumn("k", F.when(F.size("base") > 0, key(F.col("doc_id"), F.col("text"))))


def key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("-")), text))


def _terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def disclosing_terms(docs: DataFrame, some: DataFrame, n: int) -> DataFrame:
    """k, term: for each text of some (saved k, base, text: the rows with spans) the words that disclose one of its values.

    PMI = log2(c N / (df(entity) (df(term) + PRIOR))) and IC = log2(N / df(entity)) over the N = n rows of docs; c counts rows with both, and
    repeated rows count each, in df and c alike. A term discloses if PMI is at least DISCLOSED of IC. c is at most df(entity), so terms over the
    frequency that this leaves are not paired. Values that the same texts hold, such as those of a long list in one document and its copies, are paired as one,
    so are terms: a text of many values of its own and many words of its own makes one pair. Values and words that a third of the rows hold are hot keys
    of the joins: they are broadcast.
    """
    value = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    texts = some.groupBy("k").agg(F.count("*").alias("m"), F.first(value).alias("entities"), F.first(_terms_of(F.col("text"))).alias("words"))
    texts = saved(texts, "texts")
    held = saved(texts.select("k", "m", F.explode("entities").alias("entity")), "held")
    entities = saved(held.groupBy("entity").agg(F.sum("m").alias("e"), F.count("*").alias("rows"), *_holders()).where(F.col("e") < n), "entities")
    words = saved(texts.select("k", F.explode("words").alias("term")), "words")
    wanted = saved(words.groupBy("term").agg(F.count("*").alias("rows"), *_holders()), "wanted")
    every = docs.select(F.explode(_terms_of(F.coalesce("text", F.lit("")))).alias("term"))
    if wanted.limit(200_001).count() <= 200_000:
        every = every.join(F.broadcast(wanted.select("term")), "term", "left_semi")
    df_term = saved(every.groupBy("term").agg(F.count("*").alias("t")).join(wanted, "term"), "frequencies")
    most = float(entities.agg(F.max("e").alias("m")).first()["m"] or 0)
    rare = F.col("t") + PRIOR <= float(n) ** (1 - DISCLOSED) * most**DISCLOSED * (1 + 1e-9)
    values = join_skewed(held, entities, ["entity"], "rows", held.count()).select("k", "m", _kin("e").alias("entities"), "e").distinct()
    terms = saved(join_skewed(words, df_term, ["term"], "rows", words.count()).where(rare).select("k", "term", _kin("t").alias("terms"), "t"), "rare")
    bound = F.lit(float(n) ** (1 - DISCLOSED)) * F.pow("e", F.lit(DISCLOSED)) * (1 + 1e-9)
    pairs = saved(values.join(terms.select("k", "terms", "t").distinct(), "k").where(F.col("t") + PRIOR <= bound), "pairs")
    scored = pairs.groupBy("entities", "terms").agg(F.sum("m").alias("c"), F.count("*").alias("rows"), F.first("e").alias("e"), F.first("t").alias("t"))
    pmi, ic = F.log2(F.col("c") * F.lit(float(n)) / (F.col("e") * (F.col("t") + PRIOR))), F.log2(F.lit(float(n)) / F.col("e"))
    found = saved(scored.where(pmi >= DISCLOSED * ic).select("entities", "terms", "rows"), "found")
    shown = join_skewed(pairs, found, ["entities", "terms"], "rows", pairs.count()).select("k", "terms").distinct()
    return saved(terms.join(shown, ["k", "terms"]).select("k", "term"), "disclosing")


def _holders() -> list[Column]:
    """Two sums that are equal for values, or terms, which the same texts hold."""
    return [F.bit_xor(F.xxhash64("k")).alias("one"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("two")]


def _kin(frequency: str) -> Column:
    """Equal for values, or terms, of one frequency that the same texts hold: they make equal pairs with all others, so one of them stands for all."""
    return F.concat_ws(" ", *(F.col(c).cast("string") for c in ("rows", "one", "two", frequency)))


def term_places(some: DataFrame, terms: DataFrame) -> DataFrame:
    """k, terms: spans, like base's, of all places of a text's terms. Texts with terms are parted into words, which meet the terms in a join."""
    texts = some.select("k", "text").dropDuplicates(["k"]).join(terms.select("k").distinct(), "k", "left_semi")

    def words(runs: Column) -> Column:
        placed = F.zip_with(runs, running(F.transform(runs, F.length), _sum), lambda r, e: F.struct((e - F.length(r)).alias("start"), e.alias("stop"), r.alias("word")))
        return F.filter(placed, lambda w: w["word"].rlike(_LETTERS))

    places = texts.select("k", F.explode(let(F.regexp_extract_all("text", F.lit(_RUNS), F.lit(0)), words)).alias("w")).select("k", F.lower("w.word").alias("term"), "w.start", "w.stop").join(terms, ["k", "term"])
    span = F.struct("start", F.lit(len(KINDS)).alias("ord"), F.lit("term").alias("kind"), "stop", F.col("term").alias("value"))
    return saved(places.groupBy("k").agg(F.array_sort(F.collect_list(span)).cast(_SPANS).alias("terms")), "places")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base, terms of every document; terms are the places of words that disclose one of its protected values.

    Null texts are empty and have no spans; repeated rows stay and count each; a null doc_id is a document of its own text. Other
    columns are ignored.
    """
    rows = saved(spanned(docs).withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "spans")
    some = rows.where(F.size("base") > 0)
    places = term_places(some, disclosing_terms(docs, some, rows.count()))
    with_terms = some.join(places, "k", "left").select("doc_id", "base", F.coalesce("terms", _none()).alias("terms"))
    return with_terms.unionByName(rows.where(F.size("base") == 0).select("doc_id", "base", _none().alias("terms")))


def digests(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """text with each span's place as its kind in brackets; spans are sorted, and one that begins before another's end goes with it.

    Each piece of text before a span is cut from a run of pieces, and the runs from the text: a substring is found from the start of its string.
    """
    names = F.create_map(*(x for k, v in GENERAL.items() for x in (F.lit(k), F.lit(v))))

    def joined(ends: Column, s: Column) -> Column:
        pieces = F.transform(s, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.get(ends, i - 1)).alias("at"), x["start"].alias("to"), x["kind"].alias("kind")))
        fresh = F.filter(pieces, lambda p: p["at"] <= p["to"])

        def run(r: Column) -> Column:
            at = F.get(r, F.lit(0))["at"]
            part = F.substring(text, at + 1, F.element_at(r, -1)["to"] - at)
            return let(F.struct(part.alias("part"), at.alias("at")), lambda v: F.array_join(F.transform(r, lambda p: F.concat(F.substring(v["part"], p["at"] - v["at"] + 1, p["to"] - p["at"]), names[p["kind"]])), ""))

        most = F.element_at(ends, -1)
        return F.concat(F.array_join(let(fresh, lambda f: F.transform(_cut(f, _width(f)), run)), ""), F.substring(text, most + 1, F.length(text)))

    ends = lambda s: let(running(F.transform(s, lambda x: x["stop"]), lambda a, b: F.greatest(a, b)), lambda e: joined(e, s))
    return let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(ends(s)))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs, all columns, with every span's text replaced by its kind in brackets. Overlapping spans become one, named by the first.

    Only the rows with base spans are joined to terms; the others pass. n_chars, where present, follows the text. Null and empty texts stay as they are; a null doc_id
    is one as good as any; repeated rows stay and count each; columns named as those made here stay; an empty table gives none.
    """
    k, base, terms = free_names(docs, "k", "base", "terms")
    text = F.col("text")
    found = F.when(_has(text), base_spans(text)).otherwise(_none())
    some = saved(docs.withColumn(base, found).where(F.size(base) > 0).withColumn(k, key(F.col("doc_id").cast("long"), text)), "spans")
    plain = some.select(F.col(k).alias("k"), F.col(base).alias("base"), "text")
    places = term_places(plain, disclosing_terms(docs, plain, docs.count())).select(F.col("k").alias(k), F.col("terms").alias(terms))
    new = {"text": replaced(text, F.array_sort(F.concat(base, F.coalesce(terms, _none()))))}
    changed = some.join(places, k, "left").withColumns(new)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    untouched = docs.where(text.isNull() | ~_has(text) | (F.size(base_spans(text)) == 0))
    return untouched.select(*docs.columns).unionByName(changed.select(*docs.columns))
