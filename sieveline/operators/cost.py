"""Monthly cost of infrastructure files: names of a price catalog, with the count that the innermost block around each gives."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.arrays import let
from sieveline.sources.shared import ship

#: Monthly list prices in USD by provider.
PRICES = {
    "aws": {
        "t3.micro": 7.44, "t3.small": 14.88, "t3.medium": 29.76, "t3.large": 59.52, "m5.large": 69.84, "m5.xlarge": 139.68, "m5.2xlarge": 279.36, "r5.large": 100.80, "r5.xlarge": 201.60, "r5.4xlarge": 1113.12,
        "c5.xlarge": 122.40, "p3.2xlarge": 2203.20, "p4d.24xlarge": 23929.40, "db.t3.micro": 11.52, "db.m5.large": 128.48, "db.r5.xlarge": 288.00, "io2": 150.00,
    },
    "gcp": {
        "e2-micro": 6.11, "e2-small": 12.23, "e2-medium": 24.46, "e2-standard-2": 48.71, "e2-standard-4": 97.41, "n2-standard-4": 141.70, "n2-highmem-8": 425.61, "n2-highmem-16": 851.22, "a2-highgpu-1g": 2684.50, "c2-standard-8": 338.00,
    },
}
#: Characters read of a file, the most that a count may say, and the characters on each side that stand for a block where there is none.
MOST_CHARS, MOST_COUNT, AROUND = 512_000, 100, 120
#: How a block says its count; the first that it holds.
COUNTS = (r"(?i)\bcount\s*=\s*(\d+)", r"(?i)\breplicas\s*:\s*(\d+)", r"(?i)\bdesired_capacity\s*=\s*(\d+)")
#: Families of instance names, priced or not.
LOOSE = r"(?i)\b(?:(?:t2|t3|t4g|m5|m6i|m7i|r5|r6i|c5|c6i|c7i|p3|p4d|p5)\.[a-z0-9]+|db\.[a-z0-9.]+|(?:e2|n2|a2|c2)-[a-z0-9-]+)\b"
MOST_HINTS = 20


def _pattern(names) -> re.Pattern:
    return re.compile("(?<![A-Za-z0-9-])(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + ")(?![A-Za-z0-9-])", re.I)


def blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the block around it or -1) of all brace blocks, in order of their starts; one that does not close ends with the text."""
    found, stack = [], []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            found.append([m.start(), len(text), stack[-1] if stack else -1])
            stack.append(len(found) - 1)
        elif stack:
            found[stack.pop()][1] = m.end()
    return [tuple(b) for b in found]


def quantity(block: str) -> int:
    for p in COUNTS:
        if m := re.search(p, block):
            return max(1, min(int(m[1]), MOST_COUNT))
    return 1


def line_items(files: DataFrame) -> DataFrame:
    """file_id, sku, quantity, unit_usd, monthly_usd, line: the priced names of files(file_id, content, provider).

    Longer names come first, so a name inside a longer one is not billed twice. An unknown provider, a null content and a text without names
    have none. A block is looked for from the inside out, from the last to begin before the name.
    """
    ship(files.sparkSession)

    def each(batches):
        patterns = {p: _pattern(names) for p, names in PRICES.items()}
        for batch in batches:
            rows = []
            for file_id, text, provider in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                provider, text = (provider or "").strip().lower(), (text or "")[:MOST_CHARS]
                if provider not in patterns:
                    continue
                spans, counts, lines = None, {}, []
                for m in patterns[provider].finditer(text):
                    if spans is None:
                        spans = blocks(text)
                        lines = [x.start() for x in re.finditer("\n", text)]
                    i = bisect.bisect_right(spans, (m.start(), 0, 0)) - 1
                    while i >= 0 and spans[i][1] <= m.start():
                        i = spans[i][2]
                    if i >= 0:
                        if i not in counts:  # once for all names of a block
                            counts[i] = quantity(text[spans[i][0] : spans[i][1]])
                        n = counts[i]
                    else:
                        n = quantity(text[max(0, m.start() - AROUND) : m.start() + AROUND])
                    rows.append((file_id, provider, m[0].lower(), n, bisect.bisect_left(lines, m.start()) + 1))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["file_id", "provider", "sku", "quantity", "line"])

    prices = files.sparkSession.createDataFrame([(p, k, v) for p, names in PRICES.items() for k, v in names.items()], "provider string, sku string, unit_usd double")
    found = files.select(F.col("file_id").cast("long").alias("file_id"), "content", "provider").mapInArrow(each, "file_id long, provider string, sku string, quantity int, line int")
    return found.join(F.broadcast(prices), ["provider", "sku"]).select("file_id", "sku", "quantity", "unit_usd", F.round(F.col("unit_usd") * F.col("quantity"), 2).alias("monthly_usd"), "line")


def budget(files: DataFrame, items: DataFrame, findings: DataFrame, limit: float) -> DataFrame:
    """file_id, projected_monthly_burn ($1,234.50), budget_limit_exceeded, security_issue_count, gravest_rule, verdict of every file.

    findings(file_id, place, rule_id, severity) are ordered by place. Over the limit or critical is REJECTED, high is for review. A file without names costs nothing.
    """
    burn = items.groupBy("file_id").agg(F.round(F.sum("monthly_usd"), 2).alias("burn"))
    found = findings.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.min_by("rule_id", "place").alias("gravest_rule"))
    rows = files.join(burn, "file_id", "left").join(found, "file_id", "left").na.fill(0, ["burn", "n", "critical", "high"])
    over = F.col("burn") > limit
    verdict = F.when((F.col("critical") > 0) | over, "REJECTED").when(F.col("high") > 0, "REVIEW_REQUIRED").otherwise("APPROVED")
    return rows.select("file_id", F.concat(F.lit("$"), F.format_number("burn", 2)).alias("projected_monthly_burn"), over.alias("budget_limit_exceeded"), F.col("n").alias("security_issue_count"), "gravest_rule", verdict.alias("verdict"))


def unpriced(files: DataFrame) -> DataFrame:
    """file_id, name: names of instance classes that the provider's catalog does not price, in order, the first MOST_HINTS of a file."""
    priced = F.create_map(*(x for p, names in PRICES.items() for x in (F.lit(p), F.array(*map(F.lit, names)))))[F.lower("provider")]
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.left("content", F.lit(MOST_CHARS)), F.lit(LOOSE), F.lit(0))))
    hints = let(priced, lambda known: F.slice(F.filter(found, lambda n: ~F.array_contains(known, F.lower(n))), 1, MOST_HINTS))
    return files.select("file_id", F.explode(hints).alias("name"))
