"""Positions of pattern matches, lines and columns, masks: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions.arrays import let, replaced_by, running_sum

SPANS = "array<struct<start:int,length:int,hit:string>>"
OPEN, SHUT = "\u0001", "\u0002"


def match_spans(text: Column, before: str, span: str, after: str, flags: str, most: int | None = None, marked: bool = True) -> Column:
    """array<struct<start int, length int, hit string>> of all matches, or the first most, leftmost and non-overlapping; start counts code points from 0.

    Matches are marked in one replacement and the text is split at the marks, so no match is searched twice; places are running sums of the
    parts' lengths. Mark characters are taken out of the text first, where it may hold some (marked); positions count without them. Patterns may hold
    groups of their own.
    """
    plain = F.translate(text, OPEN + SHUT, "") if marked else text
    cut = F.regexp_replace(plain, f"(?dU{flags})(?<svb>{before})(?<svs>{span})(?<sva>{after})", f"${{svb}}{OPEN}${{svs}}{SHUT}${{sva}}")

    def spans(parts: Column) -> Column:
        hits = F.slice(parts, F.lit(2), F.size(parts) if most is None else F.least(F.size(parts), F.lit(most)))
        n = lambda part: F.instr(part, SHUT) - 1
        sizes = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(hits), F.lit(1))), lambda part: F.length(part) - F.when(n(part) >= 0, 1).otherwise(0))
        hit = lambda part, at: F.struct(at.alias("start"), n(part).alias("length"), F.substring(part, F.lit(1), n(part)).alias("hit"))
        return F.when(F.size(hits) == 0, F.array().cast(SPANS)).otherwise(F.zip_with(hits, running_sum(sizes), hit))

    return F.coalesce(let(F.split(cut, OPEN, -1), spans), F.array().cast(SPANS))


def line_of(text: Column, start: Column) -> Column:
    head = F.substring(text, F.lit(1), start)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, start: Column) -> Column:
    return F.length(F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)) + 1


def masked(value: Column) -> Column:
    """'' stays; up to eight characters become stars; else two characters at each edge stay and at most twelve stars stand between."""
    n = F.length(value)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), F.least(n - 4, F.lit(12))), F.right(value, F.lit(2))))


def line_text(text: Column, start: Column) -> Column:
    """The line that holds the character at start."""
    head = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    return F.concat(head, F.substring_index(F.substring(text, start + 1, F.length(text)), "\n", 1))


#: Long values in an excerpt's context that are masked too: quoted, or bare.
_QUOTED, _BARE = r"(['\"])[A-Za-z0-9_+\-/=.]{12,}\1", r"\b[A-Za-z0-9_+/=]{32,}\b"


def _veiled(text: Column) -> Column:
    quoted = lambda m: F.concat(F.left(m, F.lit(1)), masked(F.substring(m, F.lit(2), F.length(m) - 2)), F.right(m, F.lit(1)))
    return replaced_by(text, f"{_QUOTED}|{_BARE}", lambda m: F.when(m.rlike("^['\"]"), quoted(m)).otherwise(masked(m)))


def redacted_excerpt(line: Column, start: Column, stop: Column, context: int = 40) -> Column:
    """One line around a match: the match masked, long values in the context masked, context characters on each side, an ellipsis where cut."""
    raw = F.regexp_replace(F.translate(line, "\t", " "), r"[\r\n]+$", "")

    def made(v: Column) -> Column:
        n = F.length(v["raw"])
        a = F.greatest(F.lit(0), F.least(v["start"], n))
        b = F.greatest(a, F.least(v["stop"], n))
        lo, hi = F.greatest(F.lit(0), a - context), F.least(n, b + context)
        cut = lambda i, j: F.substring(v["raw"], i + 1, j - i)
        left = F.concat(F.when(lo > 0, "…").otherwise(""), cut(lo, a))
        right = F.concat(cut(b, hi), F.when(hi < n, "…").otherwise(""))
        return F.when(n == 0, "").when(a == b, _veiled(cut(lo, hi))).otherwise(F.concat(_veiled(left), masked(cut(a, b)), _veiled(right)))

    return let(F.struct(raw.alias("raw"), start.cast("int").alias("start"), stop.cast("int").alias("stop")), made)


def redacted(text: Column, shapes: str) -> Column:
    """struct<hits int, text string>: how many matches of shapes text has, and text with each of them masked; they are looked for once. Null for null."""

    def made(found: Column) -> Column:
        pieces = F.zip_with(F.split(text, shapes), F.concat(F.transform(found, masked), F.array(F.lit(""))), lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit(""))))
        return F.struct(F.size(found).alias("hits"), F.when(F.size(found) == 0, text).otherwise(F.array_join(pieces, "")).alias("text"))

    return F.when(text.isNotNull(), let(F.regexp_extract_all(text, F.lit(shapes), F.lit(0)), made))


def sanitised(text: Column, shapes: str, most: int | None = None) -> Column:
    """text with every match of shapes masked; cut to most characters, the last an ellipsis, where asked (for logs)."""
    clean = replaced_by(text, shapes, masked)
    return clean if most is None else F.when(F.length(clean) > most, F.concat(F.left(clean, F.lit(most - 1)), F.lit("…"))).otherwise(clean)
