"""The whole scan of a file by all engines, containers, data flow, rules of one's own, and what is written from them, with the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators import catalog, control, custom, scan, structural, taint
from sieveline.plans import gates, grids
from sieveline.plans.corpus import FILES_SQL, files, table
from sieveline.sources import formats, sinks
from sieveline.sources.files import changed_only
from sieveline.sources.shared import shared_path

COMMON = ["file_id", "path", "engine", "ord", "rule_id", "severity", "line", "column", "excerpt"]
#: Rules of one's own, as a file would hold them.
OWN_RULES = [
    {"id": "OWN-1", "name": "Debug output", "languages": ["Python"], "severity": "low", "pattern": r"^\s*print\((\w+)"},
    {"id": "OWN-2", "name": "Done", "pattern": r"(?i)echo\s+(done|ready)", "severity": "odd"},
    {"id": "OWN-3", "pattern": "curl", "enabled": False},
    {"id": "OWN-4", "pattern": "(broken"},
    {"id": "OWN-5", "pattern": "x", "type": "treesitter"},
    {"id": "", "pattern": "x"},
]


def engines(all_files: DataFrame, own: tuple = ()) -> DataFrame:
    """Findings of all engines (step is the engine's order): text grid without the syntax tree's twins, syntax tree, language grid of other languages, data flow, own rules."""
    tree = structural.findings(all_files)
    base = scan.collapsed(scan.without_twins(scan.grid(all_files, catalog.BASE, "regex"), tree))
    flow = taint.findings(all_files).withColumnRenamed("path", "steps").withColumnRenamed("file_path", "path").withColumn("engine", F.lit("taint"))
    parts = [base, tree, scan.grid(all_files.where("language <> 'python'"), catalog.LANGUAGE, "language"), flow]
    if own:
        parts.append(custom.findings(all_files, own))
    return reduce(DataFrame.unionByName, (p.select(*COMMON).withColumn("step", F.lit(i)) for i, p in enumerate(parts)))


def hybrid(all_files: DataFrame, own: tuple = ()) -> DataFrame:
    """Findings of all engines, of equal rule, line and start of excerpt the last, numbered within a file by severity, line, rule and column."""
    return scan.ordered(scan.merged(engines(all_files, own)), ["file_id"])


def hybrid_plan(spark, sf_dir):
    return hybrid(files(spark, sf_dir)).select("file_id", "place", "rule_id", "severity", "line")


def hybrid_engines(spark, sf_dir):
    """The engines that found something in each file, in their order, and the score of its findings."""
    found = scan.merged(engines(files(spark, sf_dir))).join(F.broadcast(scan.severity_dim(spark)), "severity")
    names = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("step", "engine"))), lambda x: x["engine"]), ",")
    return found.groupBy("file_id").agg(names.alias("engines"), F.least(F.sum("weight"), F.lit(999)).alias("risk_score"))


def taint_findings(spark, sf_dir):
    rows = taint.findings(files(spark, sf_dir))
    return rows.select("file_id", "rule_id", "severity", "line", "column", "sink", F.array_join("path", " → ").alias("path"))


def containers(all_files: DataFrame) -> DataFrame:
    """Findings of container files, routed by name and content: Docker rules, Kubernetes rules or both, each with the infrastructure rules; of equal rule and line the first."""
    head = F.lower(F.left("content", F.lit(500)))
    docker = F.contains(F.lower(F.element_at(F.split("path", "/"), -1)), F.lit("dockerfile")) | F.col("content").rlike(r"(?m)^\s*FROM\s+\S+")
    kind = F.when(docker, "dockerfile").when(F.contains(head, F.lit("kind:")) | F.contains(head, F.lit("apiversion:")), "kubernetes").otherwise("mixed")
    routed = all_files.withColumn("kind", kind)

    def part(kinds: list[str], rules, side: str) -> DataFrame:
        some = routed.where(F.col("kind").isin(*kinds))
        rows = scan.grid(some, rules, side, ("kind",), None).withColumn("step", F.lit(0)).unionByName(scan.grid(some, catalog.IAC, side, ("kind",), None).withColumn("step", F.lit(1)))
        first = rows.groupBy("file_id", "kind", "engine", "rule_id", "line").agg(F.min(F.struct("step", "ord", "column", "severity")).alias("r"))
        return first.select("file_id", "kind", F.col("engine").alias("side"), "rule_id", "line", "r.severity")

    return part(["dockerfile", "mixed"], catalog.DOCKER, "docker").unionByName(part(["kubernetes", "mixed"], catalog.K8S, "k8s"))


def container_findings(spark, sf_dir):
    return containers(files(spark, sf_dir).where("language IN ('yaml', 'dockerfile')"))


def custom_rule_findings(spark, sf_dir):
    rows = custom.findings(files(spark, sf_dir), custom.rules_of(spark, OWN_RULES))
    return rows.select("file_id", "rule_id", "severity", "line", "column", "match_length")


def diff_rollup(spark, sf_dir):
    """A scan of the changed files alone, as one row: files in the listing, files that there are, issues, the sum of their scores without a cap."""
    f = files(spark, sf_dir)
    changed = f.where("file_id % 3 = 0").select("path", F.when(F.col("file_id") % 6 == 0, "M").otherwise("D").alias("status"))
    some = changed_only(f, changed)
    kept = scan.collapsed(scan.grid(some, catalog.BASE, "regex"))
    scored = scan.risk_by_file(some, kept).agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum("issue_count"), F.lit(0)).alias("issue_count"), F.coalesce(F.sum("risk_score"), F.lit(0)).alias("risk_score"))
    return scored.join(changed.agg(F.count("*").alias("files_changed")))


def sarif_documents(spark, sf_dir):
    """What each file's SARIF document says, read back from it: rules, results, and the first rule with its score."""
    title = F.coalesce(*(F.when(F.col("rule_id") == r.id, r.title) for r in catalog.BASE))
    made = sinks.sarif(grids.base_findings(spark, sf_dir).withColumn("title", title), ["file_id"])
    rules = F.from_json(F.get_json_object("document", "$.runs[0].tool.driver.rules"), "array<struct<id:string,properties:map<string,string>>>")
    results = F.from_json(F.get_json_object("document", "$.runs[0].results"), "array<struct<ruleIndex:int,level:string>>")
    rows = made.select("file_id", rules.alias("rules"), results.alias("results"))
    return rows.select("file_id", F.size("rules").alias("n_rules"), F.size("results").alias("n_results"), F.get("rules", F.lit(0))["id"].alias("first_rule"), F.get("rules", F.lit(0))["properties"]["security-severity"].alias("first_score"), F.size(F.filter("results", lambda r: r["level"] == "error")).alias("n_errors"), F.array_max(F.transform("results", lambda r: r["ruleIndex"])).alias("last_index"))


def sarif_folder(spark, sf_dir):
    """Results of level error of each file's SARIF document, which are written to a folder by the SARIF source and read back by it."""
    formats.register(spark)
    title = F.coalesce(*(F.when(F.col("rule_id") == r.id, r.title) for r in catalog.BASE))
    folder = shared_path(spark, "sarif")
    sinks.sarif(grids.base_findings(spark, sf_dir).withColumn("title", title), ["file_id"]).select("document").write.format(formats.SARIF).mode("append").save(folder)
    back = spark.read.format(formats.SARIF).option("level", "error").load(folder)
    return back.select("rule_id", "level", "severity", F.col("uri").alias("path"), "line", "column", "fingerprint")


def metrics_lines(spark, sf_dir):
    """Calls and refusals of each tool as lines of a metrics text."""
    rows = control.metrics(control.authorised(control.requests(table(spark, sf_dir, "events"))))
    return sinks.metrics_text(rows.select("tool", "calls", "denied"))


def audit_ring(spark, sf_dir):
    """The newest calls of one tool of a tenant among the events that an audit log's ring holds."""
    return sinks.recent_audit(control.requests(table(spark, sf_dir, "events")), 20, 3, "scan_history").select("event_id", "tenant_id", "tool")


#: Worked out by hand for each Python snippet: rule, severity, line, column, sink, path.
_FLOWS = {
    0: [
        ("TAINT-002", "CRITICAL", 5, 5, "os.system", "param:run.cmd → sink:os.system"),
        ("TAINT-002", "CRITICAL", 6, 5, "subprocess.run", "param:run.cmd → binop → sink:subprocess.run"),
        ("TAINT-001", "CRITICAL", 7, 12, "eval", "param:run.cmd → sink:eval"),
    ],
    4: [("TAINT-003", "CRITICAL", 4, 5, "cur.execute", "param:find.name → f-string → var:q → sink:cur.execute")],
    16: [
        ("TAINT-003", "CRITICAL", 6, 1, "cur.execute", "source:request.args.get → var:name → binop → var:q → sink:cur.execute"),
        ("TAINT-005", "HIGH", 10, 1, "open", "source:unknown → sink:open"),
        ("TAINT-002", "CRITICAL", 13, 1, "subprocess.call", "source:request.args.get → var:name → sink:subprocess.call"),
    ],
}
_FLOW_ROWS = ", ".join(f"({k}, '{r}', '{s}', CAST({n} AS INT), CAST({c} AS INT), '{q}', '{p}')" for k, rows in _FLOWS.items() for r, s, n, c, q, p in rows)
_FLOW = f"""SELECT d.doc_id AS file_id, v.* EXCLUDE (k) FROM documents d JOIN (VALUES {_FLOW_ROWS}) AS v(k, rule_id, severity, line, "column", sink, path) ON d.doc_id % 27 = v.k WHERE d.text IS NOT NULL"""
_ENGINES = f""", ast AS ({grids._AST}){grids._TWINLESS}{grids._COLLAPSED.replace("FROM findings)", "FROM alone)")}, lang AS (SELECT l.* FROM ({grids._select("SELECT * FROM findings", catalog.LANGUAGE, engine="language")}) l WHERE path NOT LIKE '%.py'),
every AS (SELECT 0 AS step, 'regex' AS engine, file_id, rule_id, any_value(severity) AS severity, line FROM kept GROUP BY file_id, rule_id, line, left(excerpt, 40)
  UNION ALL SELECT 1, 'syntax', file_id, rule_id, severity, line FROM ast
  UNION ALL SELECT 2, 'language', file_id, rule_id, any_value(severity), line FROM lang GROUP BY file_id, rule_id, line, left(excerpt, 40)
  UNION ALL SELECT 3, 'taint', file_id, rule_id, severity, line FROM ({_FLOW}))"""
_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


def _side(kinds: str, name: str, rules) -> str:
    where = "language IN ('yaml', 'dockerfile')"
    hits = lambda some, step: f"SELECT {step} AS step, * FROM ({grids._select('SELECT * FROM findings', some, where, None)})"
    return f"""SELECT f.file_id, k.kind, '{name}' AS side, rule_id, line, arg_min(severity, step * 1000000 + ord * 1000 + "column") AS severity FROM ({hits(rules, 0)} UNION ALL {hits(catalog.IAC, 1)}) f JOIN kinds k ON f.file_id = k.file_id AND k.kind IN ({kinds}) GROUP BY ALL"""


_CONTAINERS = f"""WITH kinds AS (SELECT file_id, CASE WHEN regexp_extract(lower(path), '[^/]*$') LIKE '%dockerfile%' OR regexp_matches(content, '(?m)^\\s*FROM\\s+\\S+') THEN 'dockerfile' WHEN contains(lower(left(content, 500)), 'kind:') OR contains(lower(left(content, 500)), 'apiversion:') THEN 'kubernetes' ELSE 'mixed' END AS kind FROM ({FILES_SQL}))
{_side("'dockerfile', 'mixed'", "docker", catalog.DOCKER)} UNION ALL {_side("'kubernetes', 'mixed'", "k8s", catalog.K8S)}"""

QUERIES = {f.__name__: f for f in (hybrid_plan, hybrid_engines, taint_findings, container_findings, custom_rule_findings, diff_rollup, sarif_documents, sarif_folder, metrics_lines, audit_ring)}
ORACLES = {
    "hybrid_plan": grids._select(f"{_ENGINES} SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY {_RANK}, line, rule_id) AS place, rule_id, severity, line FROM every"),
    "hybrid_engines": grids._select(f"{_ENGINES} SELECT file_id, (SELECT string_agg(engine, ',' ORDER BY step) FROM (SELECT DISTINCT step, engine FROM every e WHERE e.file_id = v.file_id)) AS engines, CAST(least(sum({grids._WEIGHT}), 999) AS BIGINT) AS risk_score FROM every v GROUP BY file_id"),
    "taint_findings": _FLOW,
    "container_findings": _CONTAINERS,
    "custom_rule_findings": """SELECT d.doc_id AS file_id, v.* EXCLUDE (k) FROM documents d JOIN (VALUES (9, 'OWN-2', 'MEDIUM', CAST(5 AS INT), CAST(1 AS INT), CAST(9 AS INT))) AS v(k, rule_id, severity, line, "column", match_length) ON d.doc_id % 27 = v.k WHERE d.text IS NOT NULL""",
    "diff_rollup": grids._select(f"{grids._RISK} SELECT count(*) AS files_scanned, CAST(coalesce(sum(issue_count), 0) AS BIGINT) AS issue_count, CAST(coalesce(sum(risk_score), 0) AS BIGINT) AS risk_score, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS files_changed FROM scored WHERE file_id % 6 = 0"),
    "sarif_folder": grids._select("""SELECT rule_id, 'error' AS level, severity, path, CAST(line AS BIGINT) AS line, CAST("column" AS BIGINT) AS "column", left(sha256(concat_ws('|', rule_id, path, CAST(line AS VARCHAR), excerpt)), 16) AS fingerprint FROM findings WHERE severity IN ('CRITICAL', 'HIGH')"""),
    "sarif_documents": grids._select("""SELECT file_id, CAST(count(DISTINCT rule_id) AS INT) AS n_rules, CAST(count(*) AS INT) AS n_results, arg_min(rule_id, (line, "column", rule_id)) AS first_rule,
CASE arg_min(severity, (line, "column", rule_id)) WHEN 'CRITICAL' THEN '9.0' WHEN 'HIGH' THEN '7.0' WHEN 'MEDIUM' THEN '5.0' WHEN 'LOW' THEN '3.0' ELSE '1.0' END AS first_score, CAST(count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS INT) AS n_errors, CAST(count(DISTINCT rule_id) - 1 AS INT) AS last_index FROM findings GROUP BY file_id"""),
    "metrics_lines": f"""WITH {gates._ASKED}, m AS (SELECT tool, count(*) AS calls, count(*) FILTER (NOT granted) AS denied FROM granted GROUP BY tool) SELECT 'sieveline_calls' || chr(123) || 'tool="' || tool || '"' || chr(125) || ' ' || calls AS value FROM m UNION ALL SELECT 'sieveline_denied' || chr(123) || 'tool="' || tool || '"' || chr(125) || ' ' || denied FROM m""",
    "audit_ring": f"WITH {gates._ASKED} SELECT event_id, tenant_id, tool FROM (SELECT * FROM asked ORDER BY ts DESC, event_id DESC LIMIT 500) WHERE tenant_id = 3 AND tool = 'scan_history' ORDER BY ts DESC, event_id DESC LIMIT 20",
}
