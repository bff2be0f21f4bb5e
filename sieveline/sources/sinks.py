"""Where results go: SARIF documents, reports, history tables, audit logs, metrics texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Events that an audit log's ring shows, and arguments of calls that it never shows or shows as they are.
RING, MOST_SCALAR = 500, 120
HIDDEN = ("api_key", "authorization", "content", "infrastructure_content", "issues", "source_code", "token")
SHOWN = ("base", "cloud_provider", "filename", "head", "language", "mode", "path")
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
SCORES = {"CRITICAL": "9.0", "HIGH": "7.0", "MEDIUM": "5.0", "LOW": "3.0", "INFO": "1.0"}


def _of(severity: Column, names: dict[str, str], usual: str) -> Column:
    return F.coalesce(*(F.when(F.upper(severity) == k, v) for k, v in names.items()), F.lit(usual))


def fingerprint(rule: Column, path: Column, line: Column, excerpt: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", rule, path, line.cast("string"), F.coalesce(excerpt, F.lit(""))), 256), F.lit(16))


def sarif(findings: DataFrame, keys: list[str], tool: str = "sieveline", version: str = "1.0") -> DataFrame:
    """keys, document: a SARIF 2.1.0 document for each value of keys, from findings(rule_id, severity, path, line, column, excerpt, title).

    Rules are numbered by their first appearance by path, line and column. Keys name files or projects: a document holds their findings, so
    they should be no larger than a task.
    """
    place = ["path", "line", "column", "rule_id", "excerpt"]
    level = _of(F.col("severity"), LEVELS, "warning")
    one = F.struct(*place, "severity", "title", level.alias("level"), fingerprint(F.col("rule_id"), F.col("path"), F.col("line"), F.col("excerpt")).alias("mark"))
    rows = findings.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all"))
    ids = F.array_distinct(F.transform("all", lambda f: f["rule_id"]))
    first = lambda r: F.element_at(F.filter("all", lambda f: f["rule_id"] == r), 1)
    text = lambda t: F.struct(t.alias("text"))
    rules = F.transform(ids, lambda r: F.struct(r.alias("id"), first(r)["title"].alias("name"), text(first(r)["title"]).alias("shortDescription"), F.struct(first(r)["level"].alias("level")).alias("defaultConfiguration"), F.struct(_of(first(r)["severity"], SCORES, "5.0").alias("security-severity")).alias("properties")))
    region = lambda f: F.struct(F.greatest(f["line"], F.lit(1)).alias("startLine"), F.greatest(f["column"], F.lit(1)).alias("startColumn"), F.when(f["excerpt"] != "", text(f["excerpt"])).alias("snippet"))
    where = lambda f: F.array(F.struct(F.struct(F.struct(F.regexp_replace(f["path"], r"\\", "/").alias("uri")).alias("artifactLocation"), region(f).alias("region")).alias("physicalLocation")))
    said = lambda f: F.when(f["excerpt"] != "", F.concat(f["title"], F.lit(" | excerpt: "), f["excerpt"])).otherwise(f["title"])
    results = F.transform("all", lambda f: F.struct(f["rule_id"].alias("ruleId"), (F.array_position("ids", f["rule_id"]) - 1).alias("ruleIndex"), f["level"].alias("level"), text(said(f)).alias("message"), where(f).alias("locations"), F.struct(f["mark"].alias("sieveline/v1")).alias("partialFingerprints"), F.struct(f["severity"].alias("severity")).alias("properties")))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"), F.array(F.struct(F.lit(True).alias("executionSuccessful"))).alias("invocations"))
    whole = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return rows.withColumn("ids", ids).withColumn("rules", rules).withColumn("results", results).select(*keys, F.to_json(whole).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One document a line, in as many files as there are tasks."""
    documents.select(F.col("document").alias("value")).write.mode("errorifexists").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Any relation as JSON lines."""
    rows.write.mode("errorifexists").json(path)


def append_history(runs: DataFrame, path: str) -> None:
    """Append runs(run_id, ts, tenant_id, ...) to the history table, in folders by day."""
    runs.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def recent_runs(spark: SparkSession, path: str, limit: int = 50, tenant_id: int | None = None) -> DataFrame:
    """The newest runs of all tenants or one, newest first: a top-k report."""
    rows = spark.read.parquet(path).drop("day")
    if tenant_id is not None:
        rows = rows.where(F.col("tenant_id") == tenant_id)
    return rows.orderBy(F.desc("ts"), F.desc("run_id")).limit(limit)


def safe_arguments(arguments: Column) -> Column:
    """A map of a call's arguments as an audit log shows it: HIDDEN ones by their length, SHOWN ones as they are, others if they are short."""
    def shown(k: Column, v: Column) -> Column:
        hidden = F.concat(F.lit("<redacted len="), F.length(v).cast("string"), F.lit(">"))
        return F.when(k.isin(*HIDDEN), F.coalesce(hidden, F.lit("<redacted>"))).when(k.isin(*SHOWN) | (F.length(v) < MOST_SCALAR), v).otherwise("str")

    return F.transform_values(arguments, shown)


def append_audit(events: DataFrame, path: str) -> None:
    """Append events to the audit log, one JSON object a line."""
    events.write.mode("append").json(path)


def recent_audit(events: DataFrame, limit: int = 50, tenant_id: int | None = None, tool: str | None = None) -> DataFrame:
    """Of the newest RING events those of a tenant and tool, newest first, at most limit: a top-k report."""
    rows = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(RING)
    for name, value in (("tenant_id", tenant_id), ("tool", tool)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def metrics_text(metrics: DataFrame, prefix: str = "sieveline") -> DataFrame:
    """value: lines of the Prometheus text format for metrics(tool, ...numbers): one line for each tool and number."""
    numbers = [c for c in metrics.columns if c != "tool"]
    label = F.regexp_replace("tool", r'(["\\])', r"\\$1")
    return metrics.select(F.explode(F.array(*(F.concat(F.lit(f'{prefix}_{c}{{tool="'), label, F.lit('"} '), F.coalesce(F.col(c).cast("string"), F.lit("NaN"))) for c in numbers))).alias("value"))


def html_rows(rows: DataFrame) -> DataFrame:
    """value: a table row of HTML for each row, with all columns, escaped."""
    cell = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return rows.select(F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), cell(c), F.lit("</td>")) for c in rows.columns), F.lit("</tr>")).alias("value"))
