"""Unified diffs as rows: which lines of which files a change adds, and findings on those lines only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.sources.files import normal_path

_HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, path, line (in the new file), op (' ' kept, '+' added), text of the lines of git's diffs(diff_id, text) that the new files have.

    Headers are told from content by where they stand: a line that begins with @@ opens a hunk, one that begins with 'diff --git' a file, and content lines begin with a
    blank, +, - or a backslash; so '+++ b/x' names the file only before its first hunk. Deleted files have no new path and no rows. A diff is read in one group, as
    it is one text; diffs go in parallel. Null and empty texts have no rows.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn("raw", F.regexp_replace("raw", "\r$", ""))
    by_diff = Window.partitionBy("diff_id").orderBy("at")
    opened = lines.withColumn("file", F.sum(F.when(F.startswith("raw", F.lit("diff --git ")), 1).otherwise(0)).over(by_diff))
    in_file = Window.partitionBy("diff_id", "file").orderBy("at")
    hunk = F.sum(F.when(F.col("raw").rlike(_HUNK), 1).otherwise(0)).over(in_file)
    named = opened.withColumn("hunk", hunk)
    header = F.when((F.col("hunk") == 0) & F.startswith("raw", F.lit("+++ ")), F.regexp_replace(F.regexp_replace("raw", r'^\+\+\+ "?(?:b/)?', ""), '"?\t?$', ""))
    named = named.withColumn("path", F.max(header).over(Window.partitionBy("diff_id", "file")))
    inside = Window.partitionBy("diff_id", "file", "hunk").orderBy("at")
    first = F.max(F.regexp_extract("raw", _HUNK, 1).try_cast("int")).over(Window.partitionBy("diff_id", "file", "hunk"))
    is_new = F.col("raw").rlike("^[ +]")
    placed = named.where("hunk > 0 AND path <> '/dev/null'").withColumn("line", first + F.sum(F.when(is_new, 1).otherwise(0)).over(inside) - 1)
    return placed.where(is_new).select("diff_id", normal_path(F.col("path")).alias("path"), F.col("line").cast("int").alias("line"), F.left("raw", F.lit(1)).alias("op"), F.substring("raw", F.lit(2), F.length("raw")).alias("text"))


def changed_ranges(diffs: DataFrame) -> DataFrame:
    """diff_id, path, first, last: the runs of neighbouring lines that a diff adds."""
    own = Window.partitionBy("diff_id", "path").orderBy("line")
    added = diff_lines(diffs).where("op = '+'").select("diff_id", "path", "line").distinct().withColumn("run", F.col("line") - F.row_number().over(own))
    return added.groupBy("diff_id", "path", "run").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("run")


def on_changed_lines(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Of findings(path, line, ..) those on a line of ranges(path, first, last): an interval join within a path. A finding stays once, however many diffs add its line."""
    some = ranges.select(F.col("path").alias("_path"), "first", "last").distinct()
    return findings.join(some, (normal_path(F.col("path")) == F.col("_path")) & F.col("line").between(F.col("first"), F.col("last")), "left_semi")


def totals(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """path, changed_lines, issue_count of every changed file; issue_count is that of on_changed_lines()."""
    lines = ranges.groupBy("path").agg(F.sum(F.col("last") - F.col("first") + 1).alias("changed_lines"))
    found = on_changed_lines(findings, ranges).groupBy(normal_path(F.col("path")).alias("path")).agg(F.count("*").alias("issue_count"))
    return lines.join(found, "path", "left").na.fill(0, ["issue_count"])
