"""Quality rules by robust multivariate outliers: minimum-covariance-determinant estimates per language and source."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import join_skewed, saved, ship, small
from sieveline.llm.textarrays import distinct, numbered, slices, tokens

#: Dimensions of the transformed vectors, and units of their fixed-point values: sums are whole numbers, so no order of tasks changes them.
DIMENSIONS, UNIT = 5, 1024
#: Rows that a group needs to be estimated on its own; concentration steps at most, and what a step must take from the determinant to go on.
LEAST_ROWS, MOST_STEPS, GAIN = 50, 25, 1e-6
#: Distances are binned by 1/BIN up to FARTHEST. FLOOR is added to each dimension's deviation.
BIN, FARTHEST, FLOOR = 32, 128, 0.2
#: Bins that one task holds, tasks whose counts one task adds up, and pairs of group and start (some 300 bytes each) whose estimates are broadcast.
TASK_ROWS, MERGED, MOST_PAIRS = 1 << 18, 4, 60_000
#: A normal sample's deviation in units of its median absolute deviation.
MAD = 1.4826
#: Shares of a normal sample beyond the reweighting bound, and beyond the distance at which a document is rejected. Counts of repeats have far
#: heavier tails than a normal sample: the bound for rejection leaves room for them.
REWEIGHT, TAIL = 0.025, 1e-30
#: Words added to a document's own where repeated lines and words are set against them: one repeated footer says little in a short text.
SMOOTH = 200


def chi2_beyond(x: float) -> float:
    """The share of the chi-square distribution with five degrees of freedom beyond x."""
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)


def chi2_bound(beyond: float) -> float:
    """The x with that share beyond it."""
    lo, hi = 0.0, 1500.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_beyond(mid) > beyond else (lo, mid)
    return hi


CUTOFF = math.sqrt(chi2_bound(TAIL))

_WORD = np.ones(256, np.uint8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0
_LINE = np.ones(256, np.uint8)
_LINE[10] = 0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _per_row(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[rows[1:]] - total[rows[:-1]]


def text_statistics(data: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of op2's contract, and ASCII capitals, for texts that lie one after another in data."""
    n = len(rows) - 1
    starts, ends, row = tokens(data, rows, _WORD)
    out = {"n_words": np.bincount(row, minlength=n), "n_symbols": _per_row(_SYMBOL[data], rows), "n_upper": _per_row(_UPPER[data], rows)}
    inside = (_WORD[data] != 0) & ((data & 0xC0) != 0x80)
    out["word_chars"] = _per_row(inside, rows)
    a, b, line_row = tokens(data, rows, _LINE)
    seen = np.append(0, np.cumsum(inside, dtype=np.int64))
    worded = seen[b] > seen[a]
    a, b, line_row = a[worded], b[worded], line_row[worded]
    line = numbered(line_row, distinct(data, a, b)[1])
    first = np.unique(line, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_row, minlength=n) - np.bincount(line_row[first], minlength=n)
    covered = np.zeros(len(row), bool)
    at = np.flatnonzero(row[:-2] == row[2:])
    if len(at):
        word = distinct(data, starts, ends)[1]
        window = numbered(row[at], word[at], word[at + 1], word[at + 2])
        again = at[np.bincount(window)[window] > 1]
        for k in range(3):
            covered[again + k] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, and the fixed-point vector x0.. of each document; a null text counts as empty."""
    ship(docs.sparkSession)
    names = ["doc_id", "lang", "source", *COUNTS, *(f"x{i}" for i in range(DIMENSIONS))]

    def each(batches):
        for batch in batches:
            for lo, hi, data, rows in slices(batch.column(3)):
                s = text_statistics(data, rows)
                words = np.maximum(s["n_words"], 1)
                parts = [np.log(np.maximum(s["word_chars"], 1) / words), *(np.log1p(100 * a / b) for a, b in ((s["n_symbols"], words), (s["n_dup_lines"], words + SMOOTH), (s["n_repeat_words"], words + SMOOTH), (s["n_upper"], np.maximum(s["word_chars"], 1))))]
                x = [pa.array(np.rint(p * UNIT).astype(np.int64)) for p in parts]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), *(pa.array(s[c].astype(np.int64)) for c in COUNTS), *x], names=names)

    kinds = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in names[3:])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text").mapInArrow(each, kinds)


def grouped(rows: DataFrame) -> DataFrame:
    """Column grp: language and source, or the language alone, or nothing, whichever has LEAST_ROWS rows first; small ones are pooled."""
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    rows = rows.withColumn("fine", F.to_json(F.struct(lang.alias("l"), source.alias("s"))))
    fine = saved(rows.groupBy("fine").agg(F.first(lang).alias("coarse"), F.count("*").alias("n")), "sizes")
    pooled = fine.where(F.col("n") < LEAST_ROWS).groupBy("coarse").agg(F.sum("n").alias("m"))
    named = fine.join(pooled, "coarse", "left").select("fine", "n", F.when(F.col("n") >= LEAST_ROWS, F.col("fine")).when(F.col("m") >= LEAST_ROWS, F.to_json(F.struct(F.col("coarse").alias("l")))).otherwise(F.lit("{}")).alias("grp"))
    return _met(rows, saved(named, "groups"), "fine", "n").drop("fine", "n")


def _met(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the columns of a table of groups, by broadcast while that is small. A group may hold a third of all rows."""
    if table.limit(20_001).count() <= 20_000:
        return rows.join(F.broadcast(table), key)
    return join_skewed(rows, saved(table, "groups"), [key], count, rows.count())


_PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]


def _moments(x: list) -> list:
    """Count, sums and sums of products of whole-number columns."""
    return [F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in _PAIRS)]


def covariance(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance, FLOOR in it, of one row of moments."""
    mean = np.array([r[f"s{i}"] for i in range(DIMENSIONS)], float) / r["n"]
    cov = np.zeros((DIMENSIONS, DIMENSIONS))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / r["n"] - mean[i] * mean[j]
    return mean / UNIT, cov / UNIT**2 + np.eye(DIMENSIONS) * FLOOR**2


def _estimates(sums: DataFrame) -> DataFrame:
    """grp, start, rows, mean, inverse covariance (row by row) and the covariance's log determinant from moments, one row per group and start."""

    def each(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                mean, cov = covariance(r)
                out.append((r["grp"], r["start"], r["rows"], mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=["grp", "start", "rows", "mean", "inverse", "logdet"])

    return sums.mapInPandas(each, "grp string, start int, rows long, mean array<double>, inverse array<double>, logdet double")


def _square(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """rows with d2, the squared distance from each estimate (est) of their group; estimates has one row per group, with an array of them."""
    met = _met(rows, estimates, "grp", "rows").withColumn("est", F.explode("ests"))
    d = [F.col(f"x{i}") / UNIT - F.col("est.mean")[i] for i in range(DIMENSIONS)]
    d2 = sum((d[i] * d[j] * F.col("est.inverse")[i * DIMENSIONS + j] for i in range(DIMENSIONS) for j in range(DIMENSIONS)), F.lit(0.0))
    return met.withColumn("d2", F.greatest(d2, F.lit(0.0)))


def _packed(estimates: DataFrame) -> DataFrame:
    """One row per group, with an array of its (few) estimates."""
    return estimates.groupBy("grp").agg(F.first("rows").alias("rows"), F.collect_list(F.struct("start", "mean", "inverse")).alias("ests"))


def _starts(rows: DataFrame) -> DataFrame:
    """Three first estimates of each group: median deviations of each dimension; covariance of squashed values; covariance of directions from the medians.

    Values are whole numbers of 1 / UNIT, so quantiles' tables are small and sums do not depend on the order of tasks.
    """
    median = lambda c: F.percentile(c, F.lit(0.5))
    q = rows.groupBy("grp").agg(F.count("*").alias("rows"), *(median(F.col(f"x{i}")).alias(f"m{i}") for i in range(DIMENSIONS)))
    q = saved(q, "medians")
    off = _met(rows, q, "grp", "rows").groupBy("grp").agg(F.first("rows").alias("rows"), *(F.first(f"m{i}").alias(f"m{i}") for i in range(DIMENSIONS)), *(median(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))).alias(f"q{i}") for i in range(DIMENSIONS)))
    q = saved(off, "deviations")
    met = _met(rows, q, "grp", "rows")
    spread = [F.sqrt(F.pow(F.col(f"q{i}") * MAD, 2) + (FLOOR * UNIT) ** 2) for i in range(DIMENSIONS)]
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / spread[i] for i in range(DIMENSIONS)]
    size = F.sqrt(sum((c * c for c in z), F.lit(1e-12)))
    center = F.array(*(F.col(f"m{i}").cast("double") for i in range(DIMENSIONS)))
    whole = lambda c: F.rint(c * UNIT).cast("long")
    kinds = [[whole(F.tanh(c)) for c in z], [whole(c / size * DIMENSIONS**0.5) for c in z]]
    made = [(k, F.array(*kind)) for k, kind in enumerate(kinds, 1)]
    each = met.select("grp", "rows", center.alias("center"), F.array(*spread).alias("spread"), F.explode(F.array(*(F.struct(F.lit(k).alias("start"), v.alias("v")) for k, v in made))).alias("m"))
    sums = each.groupBy("grp", F.col("m.start").alias("start")).agg(F.first("rows").alias("rows"), F.first("center").alias("center"), F.first("spread").alias("spread"), *_moments([F.col("m.v")[i] for i in range(DIMENSIONS)]))
    return saved(_scaled(sums, q, center, spread), "starts")


def _scaled(sums: DataFrame, q: DataFrame, center, spread: list) -> DataFrame:
    """Estimates about the medians: the deviations themselves, and the sums' correlations with those deviations."""

    def each(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                _, cov = covariance(r)
                by = np.array(r["spread"]) / UNIT
                cov = cov * np.outer(by, by)
                out.append((r["grp"], r["start"], r["rows"], (np.array(r["center"]) / UNIT).tolist(), np.linalg.inv(cov).ravel().tolist(), math.inf))
            yield pd.DataFrame(out, columns=["grp", "start", "rows", "mean", "inverse", "logdet"])

    kind = "grp string, start int, rows long, mean array<double>, inverse array<double>, logdet double"
    inverse = F.array(*(F.pow(F.lit(UNIT) / spread[i], 2) if i == j else F.lit(0.0) for i in range(DIMENSIONS) for j in range(DIMENSIONS)))
    plain = q.select("grp", F.lit(0).alias("start"), "rows", F.transform(center, lambda c: c / UNIT).alias("mean"), inverse.alias("inverse"), F.lit(math.inf).alias("logdet"))
    return sums.mapInPandas(each, kind).unionByName(plain)


def _tasks(rows: DataFrame, pairs: int) -> int:
    """Tasks for the bins of so many pairs of group and start: enough that none makes over TASK_ROWS of them, or adds up what over MERGED tasks of rows have counted."""
    return max(-(-pairs * BIN * FARTHEST // TASK_ROWS), -(-rows.rdd.getNumPartitions() // MERGED))


def _bins(rows: DataFrame, estimates: DataFrame, pairs: int) -> DataFrame:
    """Moments of rows by group, start and distance bin, and before: the group's rows in nearer bins. A group of any size is a few thousand rows. pairs: rows of estimates."""
    binned = _square(rows, _packed(estimates).coalesce(-(-pairs // TASK_ROWS) or 1)).withColumn("bin", F.least(F.floor(F.sqrt("d2") * BIN), F.lit(FARTHEST * BIN)))
    bins = saved(binned.groupBy("grp", F.col("est.start").alias("start"), "bin").agg(F.first("rows").alias("rows"), *_moments([F.col(f"x{i}") for i in range(DIMENSIONS)])).coalesce(_tasks(rows, pairs) or 1), "bins")
    upto = Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return bins.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))


def _summed(bins: DataFrame, tasks: int) -> DataFrame:
    names = ["n", *(f"s{i}" for i in range(DIMENSIONS)), *(f"p{i}_{j}" for i, j in _PAIRS)]
    return bins.groupBy("grp", "start").agg(F.first("rows").alias("rows"), *(F.sum(c).alias(c) for c in names)).coalesce(tasks or 1)


def _median(bins: DataFrame) -> DataFrame:
    """grp, start, scale: by how much the median squared distance exceeds a normal sample's; at least 1, so FLOOR's unit never shrinks."""
    middle = bins.where(F.col("before") <= F.col("rows") * 0.5).groupBy("grp", "start").agg(F.max("bin").alias("m"))
    return middle.select("grp", "start", F.greatest(F.pow((F.col("m") + 0.5) / BIN, 2) / chi2_bound(0.5), F.lit(1.0)).alias("scale"))


_FITTED = ("mean", "inverse", "logdet")


def least_determinant(rows: DataFrame) -> DataFrame:
    """grp, start, rows, mean, inverse, logdet: for each group the estimate from half its rows with the smallest determinant found.

    From each start, a step takes the (n + DIMENSIONS + 1) / 2 rows nearest to the estimate (whole bins of distance) as the next one's core, as long as
    the determinant falls. Groups and starts that are done take no part in further passes.
    """
    active, best = _starts(rows), None
    pairs = active.count()
    for _ in range(MOST_STEPS):
        bins = _bins(rows, active, pairs)
        now = _estimates(_summed(bins.where(F.col("before") < F.floor((F.col("rows") + DIMENSIONS + 1) / 2)), _tasks(rows, pairs)))
        if best is None:
            best = saved(now.withColumn("falls", F.lit(True)), "estimates")
        else:
            new = now.select("grp", "start", F.struct(*_FITTED).alias("new"))
            falls = F.coalesce(F.col("new.logdet") < F.col("logdet") - GAIN, F.lit(False))
            both = best.join(F.broadcast(new) if pairs <= MOST_PAIRS else new, ["grp", "start"], "left").withColumn("falls", falls)
            best = saved(both.select("grp", "start", "rows", *(F.when(F.col("falls"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in _FITTED), "falls"), "estimates")
        active = best.where("falls")
        pairs = active.count()
        if not pairs:
            break
    first = F.min_by(F.struct("start", "rows", "mean", "inverse", "logdet"), F.struct("logdet", "start")).alias("b")
    return saved(best.groupBy("grp").agg(first).select("grp", "b.*"), "least")


def robust_distances(rows: DataFrame) -> DataFrame:
    """rows (grp, x0..) with distance: Mahalanobis, from the reweighted minimum-covariance-determinant estimate of their group.

    The raw estimate's distances are scaled to a normal sample's median; rows within the REWEIGHT bound give the final estimate, scaled likewise.
    """
    least = least_determinant(rows)
    groups = least.count()
    raw = _bins(rows, least, groups)
    near = raw.join(_median(raw), ["grp", "start"]).where(F.pow(F.col("bin") / BIN, 2) <= F.col("scale") * chi2_bound(REWEIGHT))
    estimates = saved(_estimates(_summed(near, _tasks(rows, groups))), "reweighted")
    final = estimates.join(_median(_bins(rows, estimates, groups)), ["grp", "start"])
    packed = saved(final.select("grp", "rows", F.array(F.struct("start", "mean", "inverse", "scale")).alias("ests")), "final")
    return _square(rows, packed).withColumn("distance", F.sqrt(F.col("d2") / F.col("est.scale"))).drop("d2", "est", "ests", "rows")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept and distance of every document.

    A document fails the base if it has under 50 words or over half of them repeat in 3-word windows; it is kept if it passes
    and its distance is at most CUTOFF, a chi-square quantile. Groups of language and source under LEAST_ROWS rows are pooled by language, then
    all together. Null language or source is a value of its own; null texts are empty and fail. Repeated rows stay. An empty table
    gives no rows.
    """
    rows = saved(grouped(saved(statistics(docs), "statistics")), "rows")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = robust_distances(rows).withColumn("base_failed", failed)
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("distance") <= CUTOFF)).alias("kept"), "distance")
