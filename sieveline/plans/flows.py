"""Queries over projects, trees, diffs and streams of files and requests, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import catalog, control, reach, trees
from sieveline.plans import grids
from sieveline.plans.corpus import SNIPPETS, files, spread, table
from sieveline.sources import diffs
from sieveline.sources.shared import saved, shared_path, ship
from sieveline.streaming import gateway, increments, live


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project of a module for every document: each passes what it gets on to the module of a third of its number.

    A module adds the first word of its document, or, for German documents, escapes the value, which ends the flow; some modules run the value, some begin with one from outside.
    """
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    i, parent = F.col("doc_id"), F.floor(F.col("doc_id") / 3)
    onward = i >= 3
    word = F.regexp_extract("text", "[a-z]+", 0)
    content = F.concat(
        F.lit("import os\nfrom flask import request\n"),
        F.when(onward, F.concat(F.lit("from m"), parent.cast("string"), F.lit(" import handle as onward\n"))).otherwise(""),
        F.lit("WORD = '"), word, F.lit("'\ndef handle(value):\n    clean = "), F.when(F.col("lang") == "de", "escape(value)").otherwise("value + WORD"), F.lit("\n"),
        F.when(i % 7 == 3, "    os.system(clean)\n").otherwise(""), F.when(onward, "    return onward(clean)\n").otherwise("    return clean\n"),
        F.when(i % 10 == 0, "handle(request.args.get('q'))\n").otherwise(""),
    )
    return d.select(F.lit("all").alias("project"), i.alias("file_id"), F.concat(F.lit("m"), i.cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), content.alias("content"))


def taint_reachability(spark, sf_dir):
    """Sinks that values from outside reach through calls between the files of a project, and through how many functions."""
    return reach.findings(project_files(spark, sf_dir)).select("file_id", "rule_id", "severity", "line", "column", "sink", "source", "hops")


#: Rules of one's own for trees, as JSON holds them.
OWN_RULES = """[
  {"id": "OWN-1", "severity": "low", "kind": "Return", "holds": {"kind": "Name", "text": "eval|sum"}, "within": {"kind": "FunctionDef"}},
  {"id": "OWN-2", "severity": "high", "kind": "Call", "parts": [{"slot": "func", "kind": "Attribute", "text": "load"}], "lacks": {"slot": "keywords", "kind": "keyword", "text": "Loader"}},
  {"id": "OWN-3", "kind": "Name", "text": "never", "enabled": false}
]"""


def tree_findings(spark, sf_dir):
    """Findings of the tree rules and of rules of one's own in Python files."""
    return trees.findings(files(spark, sf_dir), [*trees.RULES, *trees.loaded(OWN_RULES)]).select("file_id", "rule_id", "severity", "line", "column", "excerpt")


#: Worked out by hand for each Python snippet of the corpus. Lines count the document's line before it.
_TREES = {
    0: [("TREE-PY-002", "HIGH", 5, 5, "os.system(cmd)"), ("TREE-PY-002", "HIGH", 6, 5, 'subprocess.run("ls " + cmd, shell=True)'), ("TREE-PY-001", "CRITICAL", 7, 12, "eval(cmd)"), ("OWN-1", "LOW", 7, 5, "return eval(cmd)")],
    1: [("OWN-2", "HIGH", 5, 8, "yaml.load(text)")],
    2: [("OWN-1", "LOW", 3, 5, "return sum(x.price for x in items)")],
    4: [("TREE-PY-001", "CRITICAL", 5, 5, "eval(eval(y))"), ("TREE-PY-001", "CRITICAL", 5, 10, "eval(y)"), ("TREE-PY-001", "CRITICAL", 5, 26, 'exec("1")')],
    16: [("TREE-PY-002", "HIGH", 13, 1, "subprocess.call(name)")],
}


def file_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for each file but every fifth: of the lines after the first, those whose number and the file's are even together are added, the others were there."""
    f = files(spark, sf_dir).where("file_id % 5 <> 0")
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.concat(F.when((i > 0) & ((i + 1 + F.col("file_id")) % 2 == 0), "+").otherwise(" "), x))
    body = F.array_join(lines, "\n")
    new = F.size(lines)
    old = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(" "))))
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\nindex 1..2 100644\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ -1,"), old.cast("string"), F.lit(" +1,"), new.cast("string"), F.lit(" @@\n"))
    return f.select(F.col("file_id").alias("diff_id"), F.concat(head, body, F.lit("\n-gone\n\\ No newline at end of file")).alias("text"))


def diff_findings(spark, sf_dir):
    """Findings of the base grid on lines that a diff adds."""
    ranges = saved(diffs.changed_ranges(file_diffs(spark, sf_dir)), "ranges")
    return diffs.on_changed_lines(grids.base_findings(spark, sf_dir), ranges).select(*grids.FINDING)


def diff_totals(spark, sf_dir):
    """Of every changed file the lines added and the findings on them."""
    return diffs.totals(grids.base_findings(spark, sf_dir), saved(diffs.changed_ranges(file_diffs(spark, sf_dir)), "ranges"))


def incremental_stream(spark, sf_dir):
    """Entries, hits and misses of a cache over two arrivals of the files; in the second every seventh has other content, every eleventh another time, every tenth is new."""
    f = files(spark, sf_dir).withColumn("modified", F.timestamp_micros(F.col("file_id") * 1_000_000))
    root = shared_path(spark, "arrivals")
    first = f.where("file_id % 10 <> 0")
    second = f.withColumns({"content": F.when(F.col("file_id") % 7 == 0, F.concat("content", F.lit("eval(x)\n"))).otherwise(F.col("content")), "modified": F.when(F.col("file_id") % 11 == 0, F.timestamp_micros(F.col("file_id") * 1_000_000 + 7)).otherwise(F.col("modified"))})
    to = f"{root}/scans"
    increments.opened(spark, to)
    # an arrival is many files, written by as many tasks as its rows are in; without a limit to a trigger, what has arrived is one batch
    for part in (first, second):
        part.select("path", "language", "content", "modified").write.mode("append").parquet(f"{root}/files")
        stream = spark.readStream.schema("path string, language string, content string, modified timestamp").parquet(f"{root}/files")
        increments.run(stream, catalog.BASE, to, f"{root}/progress")
    found = spark.read.schema("path string, rule_id string, severity string, line int, column int, excerpt string, batch long").parquet(f"{to}/findings").groupBy("batch").agg(F.count("*").alias("issues"))
    return increments.statistics(spark, to).join(found, "batch", "left").select("batch", "entries", "hits", "misses", "hit_rate", F.coalesce("issues", F.lit(0)).alias("issues"))


def stream_rate_limits(spark, sf_dir):
    """Requests that a stream admits and refuses by tenant and day, in order of event time."""
    ship(spark)
    asked = live.request_stream(table(spark, sf_dir, "events")).select("event_id", "ts", "tenant_id", "user_id")
    at = shared_path(spark, "requests")
    asked.write.parquet(at)
    stream = spark.readStream.schema(asked.schema).parquet(at)
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", gateway.STORE)
    try:
        decided = live.drained(gateway.limited(stream, ["tenant_id", "user_id"], 2, 2), "decided")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    return decided.groupBy("tenant_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("denied"))


_REACH = """
WITH RECURSIVE d AS (SELECT doc_id AS i, CASE WHEN doc_id >= 3 THEN doc_id // 3 END AS p, coalesce(lang, '') <> 'de' AS flows FROM documents),
reached(i, hops) AS (SELECT i, 1 FROM d WHERE i % 10 = 0 UNION SELECT d.p, hops + 1 FROM reached JOIN d USING (i) WHERE d.p IS NOT NULL AND d.flows)
SELECT i AS file_id, 'TAINT-002' AS rule_id, 'CRITICAL' AS severity, CAST(CASE WHEN p IS NULL THEN 6 ELSE 7 END AS INT) AS line, CAST(5 AS INT) AS "column", 'os.system' AS sink, 'source:request.args.get' AS source, CAST(min(hops) AS BIGINT) AS hops
FROM reached JOIN d USING (i) WHERE i % 7 = 3 AND flows GROUP BY ALL"""
_TREE = "SELECT d.doc_id AS file_id, v.* EXCLUDE (k) FROM documents d JOIN (VALUES " + ", ".join(f"({k}, '{r}', '{s}', CAST({n} AS INT), CAST({c} AS INT), '{x}')" for k, rows in _TREES.items() for r, s, n, c, x in rows) + f""") AS v(k, rule_id, severity, line, "column", excerpt) ON d.doc_id % {len(SNIPPETS)} = v.k WHERE d.text IS NOT NULL"""
_ADDED = "file_id % 5 <> 0 AND line > 1 AND (line + file_id) % 2 = 0"
_DIFF_TOTALS = f"""SELECT path, CAST(count(*) AS BIGINT) AS changed_lines, CAST(any_value(coalesce(n, 0)) AS BIGINT) AS issue_count FROM
  (SELECT file_id, path, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line FROM files) LEFT JOIN (SELECT file_id, count(*) AS n FROM findings WHERE {_ADDED} GROUP BY file_id) USING (file_id) WHERE {_ADDED} GROUP BY path"""
_ISSUES = "SELECT file_id, count(*) AS n FROM findings GROUP BY file_id"
_INCREMENTAL = f""", n AS ({_ISSUES}), b AS (SELECT 0 AS batch, count(*) AS entries, 0 AS hits, count(*) AS misses FROM files WHERE file_id % 10 <> 0
  UNION ALL SELECT 1, count(*), count(*) FILTER (file_id % 10 <> 0 AND file_id % 7 <> 0 AND file_id % 11 <> 0), count(*) FILTER (file_id % 10 = 0 OR file_id % 7 = 0 OR file_id % 11 = 0) FROM files),
 i AS (SELECT 0 AS batch, sum(n) AS issues FROM n WHERE file_id % 10 <> 0 UNION ALL SELECT 1, (SELECT sum(n) FROM n) + (SELECT count(*) FROM files LEFT JOIN n USING (file_id) WHERE file_id % 7 = 0 AND coalesce(n, 0) < 100))
SELECT CAST(batch AS BIGINT) AS batch, CAST(entries AS BIGINT) AS entries, CAST(hits AS BIGINT) AS hits, CAST(misses AS BIGINT) AS misses, round(hits / greatest(1, hits + misses), 3) AS hit_rate, CAST(coalesce(issues, 0) AS BIGINT) AS issues FROM b JOIN i USING (batch)"""
_LIMITS = """
WITH RECURSIVE asked AS (SELECT user_id % 10 AS tenant_id, user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
step(tenant_id, user_id, k, t, tokens, admitted) AS (
  SELECT tenant_id, user_id, k, t, 1.0::DOUBLE, true FROM asked WHERE k = 1
  UNION ALL SELECT a.tenant_id, a.user_id, a.k, a.t, least(2.0, s.tokens + (a.t - s.t) / 86400000000.0 * 2) - CASE WHEN least(2.0, s.tokens + (a.t - s.t) / 86400000000.0 * 2) >= 1 THEN 1 ELSE 0 END, least(2.0, s.tokens + (a.t - s.t) / 86400000000.0 * 2) >= 1
  FROM step s JOIN asked a ON a.user_id = s.user_id AND a.k = s.k + 1)
SELECT tenant_id, CAST(count(*) FILTER (admitted) AS BIGINT) AS admitted, CAST(count(*) FILTER (NOT admitted) AS BIGINT) AS denied FROM step
WHERE t // 1000 <= (SELECT max(t) // 1000 - 3600000 FROM asked) GROUP BY tenant_id"""

QUERIES = {f.__name__: f for f in (taint_reachability, tree_findings, diff_findings, diff_totals, incremental_stream, stream_rate_limits)}
ORACLES = {
    "taint_reachability": _REACH,
    "tree_findings": _TREE,
    "diff_findings": grids._select(f"{grids._ALL} WHERE {_ADDED}"),
    "diff_totals": grids._select(_DIFF_TOTALS),
    "incremental_stream": grids._select(_INCREMENTAL),
    "stream_rate_limits": _LIMITS,
}
