"""Detector grids over files(file_id, path, language, content), and what follows them: dedupe, scores, verdicts, rollups."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.arrays import let
from sieveline.functions.spans import OPEN, SHUT, column_of, line_of, line_text, match_spans, redacted_excerpt
from sieveline.operators.catalog import DEDUCTIONS, FAMILIES, RANKS, TWINS, WEIGHTS, Rule

#: Findings of one engine in one file, and the bound of a file's risk score.
MOST_FINDINGS, MOST_RISK = 100, 999
#: Characters of a line that are looked at for an excerpt, and of a line shown as it is.
MOST_LINE, MOST_PLAIN = 8000, 160
#: Fixed value: characters on each side of a match that a rule's context is looked for in.
AROUND = 80


def severity_dim(spark) -> DataFrame:
    return spark.createDataFrame([(s, w, RANKS[s], DEDUCTIONS[s]) for s, w in WEIGHTS.items()], "severity string, weight int, rank int, deduction int")


def grid(files: DataFrame, rules: tuple[Rule, ...], engine: str, keep: tuple[str, ...] = (), most: int | None = MOST_FINDINGS) -> DataFrame:
    """file_id, path, engine, ord, rule_id, severity, line, column, match_length, excerpt, truncated: one row per match, no shuffle.

    All rules are evaluated in one pass over a file; an anchor spares a text the pattern. At most most per file are kept (None: all),
    in rule order, then by position; truncated says that the file had more. keep names further columns of files that go along.
    """
    # the array is named once only, or the optimiser would put its whole expression in each place
    out = files.select("file_id", "path", "content", *keep, F.explode(let(_once(F.col("content"), rules), lambda v: _hits(v, rules, most))).alias("h"))
    text, start = F.col("content"), F.col("h.start")
    return out.select(
        "file_id", "path", F.lit(engine).alias("engine"), F.col("h.ord").alias("ord"), F.col("h.rule_id").alias("rule_id"), F.col("h.severity").alias("severity"),
        line_of(text, start).alias("line"), column_of(text, start).alias("column"), F.col("h.length").alias("match_length"), shown(text, start, F.col("h.length"), F.col("h.rule_id"), rules, engine).alias("excerpt"), F.col("h.more").alias("truncated"), *keep,
    )


def _once(text, rules: tuple[Rule, ...]):
    """text without the marks of match_spans(), and, where a rule asks for it, folded(text): what all rules look at."""
    marks = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(SHUT))
    return F.struct(F.when(marks, F.translate(text, OPEN + SHUT, "")).otherwise(text).alias("text"), (folded(text) if any(r.any for r in rules) else F.lit("")).alias("lower"), F.col("language"))


def folded(text):
    """The ASCII characters of text in lower case, those of other scripts that patterns take for ASCII letters among them; each plain word of F.lower(text) is in it.

    F.lower() of a text that is not ASCII goes through the rules of all scripts, which takes longer than all else that a grid does.
    """
    alike = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), (("\u017f", "s"), ("\u212a", "k"), ("\u0130", "i")), text)
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(alike, r"[^\x00-\x7F]+", "")))


def _holds(text, word: str):
    """Whether text contains word. A plain pattern of four characters or more is searched for in leaps; F.contains() looks at each byte, and again at each that the word begins with."""
    return F.contains(text, F.lit(word)) if len(word) < 4 else text.rlike(re.sub(r"([^\w\s])", r"\\\1", word))


def _hits(v, rules: tuple[Rule, ...], most: int | None):
    hits = []
    for i, r in enumerate(rules):
        rows = _tagged(match_spans(v["text"], r.before, r.span, r.after, r.flags, most and most + 1, marked=False), i, r)
        fits = F.lit(True) if not r.languages or "*" in r.languages else v["language"].isin(*r.languages)
        if r.anchor:
            fits = fits & _holds(v["text"], r.anchor)
        if r.any:
            fits = fits & reduce(lambda a, b: a | b, (_holds(v["lower"], x) for x in r.any))
        if r.context:
            rows = F.filter(rows, _near(v["text"], r.context))
        hits.append(F.when(fits, rows).otherwise(F.array().cast("array<struct<ord:int,start:int,rule_id:string,severity:string,length:int,hit:string>>")))
    capped = lambda v: F.transform(v if most is None else F.slice(v, 1, most), lambda h: h.withField("more", F.lit(False) if most is None else F.size(v) > most))
    return let(F.concat(*hits), capped)


def _near(text, context: str):
    return lambda m: F.substring(text, F.greatest(m["start"] - AROUND, F.lit(0)) + 1, m["length"] + AROUND + F.least(m["start"], F.lit(AROUND))).rlike(context)


def shown(text, start, length, rule_id, rules: tuple[Rule, ...], engine: str):
    """The excerpt of a finding: the line around it with what must not be shown masked.

    A secret, and what a language rule or a rule of one's own finds, is masked in its line and shown with the words around it; a line of other text rules begins the excerpt, with long
    values in it masked; infrastructure lines are shown as they are, at most MOST_PLAIN characters.
    """
    line = line_text(text, start)
    at = column_of(text, start) - 1
    masked_span = redacted_excerpt(F.left(line, F.lit(MOST_LINE)), at, F.least(at + length, F.length(line)))
    if engine in ("language", "custom"):
        return masked_span
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    if engine != "regex":
        return F.left(bare, F.lit(MOST_PLAIN))
    clipped = F.when(F.length(bare) > MOST_PLAIN, F.concat(F.left(bare, F.lit(MOST_PLAIN - 3)), F.lit("…"))).otherwise(bare)
    secret = [r.id for r in rules if r.secret]
    return F.when(rule_id.isin(*secret) if secret else F.lit(False), masked_span).otherwise(redacted_excerpt(clipped, F.lit(0), F.lit(0)))


def _tagged(found, i: int, r: Rule):
    return F.transform(found, lambda m: F.struct(F.lit(i).alias("ord"), m["start"].alias("start"), F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), m["length"].alias("length"), m["hit"].alias("hit")))


def family(rule_id: str = "rule_id"):
    """The family of a rule that has one, else null."""
    return F.coalesce(*(F.when(F.startswith(rule_id, F.lit(f)), f) for f in FAMILIES))


def collapsed(findings: DataFrame) -> DataFrame:
    """Of findings of one family on one line with one severity the first, by rule order, then column; findings without a family all stay."""
    own = Window.partitionBy("file_id", "_f", "line", "severity").orderBy("ord", "column")
    return findings.withColumn("_f", family()).withColumn("_n", F.when(F.col("_f").isNotNull(), F.row_number().over(own)).otherwise(1)).where("_n = 1").drop("_n", "_f")


def without_twins(findings: DataFrame, structural: DataFrame) -> DataFrame:
    """Findings of the base grid less those whose family TWINS pairs with one that a structural engine reports on the same line."""
    twin = lambda of: F.coalesce(*(F.when(F.startswith("rule_id", F.lit(k)), v) for k, v in of.items()))
    seen = structural.select("file_id", "line", twin({v: v for v in TWINS.values()}).alias("_twin")).where("_twin is not null").distinct()
    return findings.withColumn("_twin", twin(TWINS)).join(seen, ["file_id", "line", "_twin"], "left_anti").drop("_twin")


def ordered(findings: DataFrame, keys: list[str]) -> DataFrame:
    """findings with place: their number from 1 within keys by severity rank, line, rule, column. One file's findings are one group."""
    own = Window.partitionBy(*keys).orderBy("rank", "line", "rule_id", "column")
    ranked = findings.join(F.broadcast(severity_dim(findings.sparkSession).select("severity", "rank")), "severity")
    return ranked.withColumn("place", F.row_number().over(own)).drop("rank")


def merged(findings: DataFrame) -> DataFrame:
    """Findings of several engines (column step, their order): one per file, rule, line and start of excerpt, the last, at the place of the first."""
    start = F.left("excerpt", F.lit(40))
    return last_wins(findings.withColumn("head", start), ["file_id", "rule_id", "line", "head"], ["step", "ord", "column"]).drop("place", "head")


def last_wins(findings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the values of the last by order, at the place of the first (column place)."""
    rest = [c for c in findings.columns if c not in keys]
    got = findings.groupBy(*keys).agg(F.min(F.struct(*order)).alias("place"), F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return got.select(*keys, "row.*", "place")


def risk_level(score):
    return F.when(score <= 0, "NONE").when(score < 20, "LOW").when(score < 50, "MEDIUM").when(score < 100, "HIGH").otherwise("CRITICAL")


def risk_by_file(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Every file with its score (weights, at most MOST_RISK), level, verdict and number of findings."""
    weighted = findings.join(F.broadcast(severity_dim(files.sparkSession)), "severity")
    sums = weighted.groupBy("file_id").agg(F.least(F.sum("weight"), F.lit(MOST_RISK)).alias("risk_score"), F.count("*").alias("issue_count"))
    out = files.select("file_id", "path", "language").join(sums, "file_id", "left").na.fill(0, ["risk_score", "issue_count"])
    return out.select("file_id", "path", "language", "risk_score", risk_level(F.col("risk_score")).alias("risk_level"), "issue_count", F.when(F.col("risk_score") >= 40, "REJECTED").otherwise("APPROVED").alias("verdict"))


def with_fallback(scored: DataFrame, findings: DataFrame) -> DataFrame:
    """scored with fallback: whether a score of 0 gave way to the sum of the weights of findings(file_id, severity); an unknown severity weighs as MEDIUM."""
    dim = severity_dim(scored.sparkSession).select("severity", "weight")
    sums = findings.select("file_id", F.upper("severity").alias("severity")).join(F.broadcast(dim), "severity", "left").groupBy("file_id").agg(F.sum(F.coalesce("weight", F.lit(WEIGHTS["MEDIUM"]))).alias("_sum"))
    rows = scored.join(sums, "file_id", "left").withColumn("fallback", (F.col("risk_score") == 0) & (F.coalesce("_sum", F.lit(0)) > 0))
    return rows.withColumn("risk_score", F.when(F.col("fallback"), F.col("_sum")).otherwise(F.col("risk_score")).cast("long")).drop("_sum")


def include_clean(files: DataFrame, findings: DataFrame, clean: bool) -> DataFrame:
    """findings(path, ..), and, where clean, one row of nulls for each of files(path) without any."""
    return files.select("path").distinct().join(findings, "path", "left" if clean else "inner")


def rollup(scored: DataFrame, findings: DataFrame) -> DataFrame:
    """The whole scan as one row: files, issues, the capped sum of scores, level and verdict."""
    critical = findings.agg(F.coalesce(F.bool_or(F.col("severity") == "CRITICAL"), F.lit(False)).alias("critical"))
    total = scored.agg(F.count("*").alias("files_scanned"), F.count_if(F.col("issue_count") > 0).alias("files_with_issues"), F.coalesce(F.sum("issue_count"), F.lit(0)).alias("issue_count"), F.least(F.coalesce(F.sum("risk_score"), F.lit(0)), F.lit(99999)).alias("risk_score"))
    out = total.join(F.broadcast(critical))
    verdict = F.when((F.col("risk_score") >= 40) | F.col("critical"), "REJECTED").otherwise("APPROVED")
    return out.select("files_scanned", "files_with_issues", "issue_count", "risk_score", risk_level(F.least("risk_score", F.lit(MOST_RISK))).alias("risk_level"), verdict.alias("verdict"))


def scorecard(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Security score 0..100 and grade by keys, with findings of each severity."""
    d = findings.join(F.broadcast(severity_dim(findings.sparkSession)), "severity")
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in WEIGHTS]
    out = d.groupBy(*keys).agg(*counts, F.greatest(F.lit(0), 100 - F.sum("deduction")).alias("score"))
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").when(F.col("score") >= 40, "D").otherwise("F")
    return out.withColumn("grade", grade)
