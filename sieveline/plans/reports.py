"""Queries that put the parts together: policy with reasons, who asks, metrics, evidence, rollups, budgets, scans of a folder; with the SQL that checks them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.engine import Engine
from sieveline.operators import catalog, control, cost, inventory, scan
from sieveline.plans import gates, grids, hybrid, supply
from sieveline.plans.corpus import files, table
from sieveline.sources.files import bounded, scan_folder
from sieveline.sources.shared import saved, shared_path, ship

#: Tenants of the policy queries: their pack, severities that fail, most risk; a null leaves it to the pack.
TENANTS = [(1, "strict", None, None), (2, "pci", "MEDIUM,HIGH", 10), (3, "nosuch", None, None), (4, None, None, 5), (5, "soc2", "LOW", None)]


def _judged(spark, sf_dir):
    kept = saved(scan.collapsed(grids.base_findings(spark, sf_dir)).select("file_id", "severity"), "findings")
    risk = scan.risk_by_file(files(spark, sf_dir), kept.withColumn("rule_id", F.lit("")))
    asked = risk.select("file_id", (F.col("file_id") % 10).alias("tenant_id"), "risk_score", F.col("verdict").alias("upstream"))
    tenants = spark.createDataFrame(TENANTS, "tenant_id long, pack string, fail_on string, max_risk int")
    scored = control.overridden(asked, tenants, control.packs(spark))
    return control.gated(scored, kept.groupBy("file_id", "severity").agg(F.count("*").alias("n")))


def policy_reasons(spark, sf_dir):
    """The decision on every file by its tenant's limits, with all reasons."""
    return _judged(spark, sf_dir).select("file_id", "tenant_id", "pack", "blocking", "decision", F.array_join("reasons", "; ").alias("reasons"))


def compliance_evidence(spark, sf_dir):
    """Allowed and denied files among the last hundred decisions of each of three tenants."""
    rows = _judged(spark, sf_dir).select((F.col("file_id") % 3).alias("tenant_id"), F.timestamp_seconds("file_id").alias("ts"), F.col("file_id").alias("event_id"), "decision")
    return control.evidence(rows)


def key_roles(spark, sf_dir):
    """Requests by the tenant and the role that their keys stand for. Every 50th subject's key is listed nowhere; some roles are named for keys, some for their hashes."""
    asked = control.requests(table(spark, sf_dir, "events")).withColumn("api_key", F.concat(F.lit("k"), F.col("user_id").cast("string")))
    users = asked.select("user_id", "api_key").distinct().where("user_id % 50 <> 0")
    named = F.when(F.col("user_id") % 4 == 0, F.struct(F.col("api_key").alias("key"), F.lit("admin").alias("role"))).when(F.col("user_id") % 4 == 1, F.struct(F.left(F.sha2("api_key", 256), F.lit(16)).alias("key"), F.lit("viewer").alias("role")))
    tenants = users.groupBy((F.col("user_id") % 7).alias("tenant_id")).agg(F.first(F.lit(0)).alias("place"), F.collect_list("api_key").alias("api_keys"), F.map_from_entries(F.collect_list(named)).alias("roles"))
    return control.principals(asked, tenants).groupBy(F.coalesce("tenant_id", F.lit(-1)).alias("tenant_id"), "role", "known").agg(F.count("*").alias("n"))


def gateway_metrics(spark, sf_dir):
    """Counts of a gateway over all requests: every 13th call that gets through fails, policy denies every 17th."""
    rows = gates.answered(spark, sf_dir)
    ok = F.col("status") == "OK"
    rows = rows.select("tool", F.when(ok & (F.col("event_id") % 13 == 0), "ERROR").otherwise(F.col("status")).alias("status"), F.col("value").alias("latency_ms"), (ok & (F.col("event_id") % 17 == 0)).alias("denied"))
    out = control.snapshot(rows)
    return out.withColumn("by_tool", F.array_join(F.transform(F.array_sort(F.map_entries("by_tool")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


def risk_with_fallback(spark, sf_dir):
    """Files with the score of the base engine, or, where that found nothing, the sum of the weights of what the language rules found."""
    base = grids.risk_by_file(spark, sf_dir).select("file_id", "path", "risk_score")
    return scan.with_fallback(base, scan.grid(files(spark, sf_dir), catalog.LANGUAGE, "language")).select("file_id", "path", "risk_score", F.col("fallback"))


def _all_findings(spark, sf_dir):
    """Findings in files and in dependencies, as one relation."""
    found = grids.base_findings(spark, sf_dir).join(files(spark, sf_dir).select("file_id", "language"), "file_id").select("language", "severity", "rule_id")
    return found.unionByName(supply.inventory_vulnerabilities(spark, sf_dir).select(F.lit("dependency").alias("language"), "severity", "rule_id"))


def severity_by_language(spark, sf_dir):
    """Findings by language and severity, with a total for each language and one for all; level says which (0 a cell, 1 a language, 3 all)."""
    rows = _all_findings(spark, sf_dir).rollup("language", "severity").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("findings"), F.countDistinct("rule_id").alias("rules"))
    return rows.select("language", "severity", "level", "findings", "rules")


def vulnerability_rollup(spark, sf_dir):
    """Of every project the packages found, those with known vulnerabilities, and how many these are, critical ones apart."""
    known = spark.createDataFrame(supply.ADVISORIES, "ecosystem string, name string, version string, id string, score string, stated string")
    return inventory.rollup(inventory.components(supply.manifests(spark, sf_dir)), known)


def infra_budget(spark, sf_dir):
    """Cost of infrastructure files of two providers against a budget, with what is found in them: the burn as text, the verdict, and the gravest finding."""
    gcp = F.col("file_id") % 2 == 1
    f = files(spark, sf_dir).where("language = 'terraform'")
    f = f.withColumn("provider", F.when(gcp, "gcp").otherwise("aws")).withColumn("content", F.when(gcp, F.concat("content", F.lit('pool { name = "n2-highmem-16" count = 2 }\n'))).otherwise(F.col("content")))
    found = scan.grid(f, catalog.IAC, "iac", most=None)
    return cost.budget(f.select("file_id"), cost.line_items(f), scan.ordered(found, ["file_id"]), 1000.0)


#: Files of the corpus in each of the folders that it is spread over.
FOLDER_FILES = 4096


def written_folder(spark: SparkSession, sf_dir: str) -> str:
    """The files of the corpus in a folder, and beside each some that a scan leaves out: one in a folder of packages, one that is too long, one of another kind.

    They lie in folders of about FOLDER_FILES of them, named by a hash of the path, as a folder is listed by one task.
    """
    ship(spark)
    root = shared_path(spark, "folder")
    some = files(spark, sf_dir).select("path", "content")
    part = F.pmod(F.xxhash64("path"), F.lit(some.count() // FOLDER_FILES + 1))

    def each(batches):
        from sieveline.sources.files import _at

        fs, at = _at(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, _, name = path.rpartition("/")
                more = [(f"{folder}/node_modules", name, "eval(x)"), (folder, f"{name}.txt", "eval(x)")]
                if name.endswith("0.js"):
                    more.append((folder, f"long-{name}", "eval(x)\n" * 70_000))
                for under, p, text in [(folder, name, content), *more]:
                    if under not in made:
                        fs.create_dir(f"{at}/{under}", recursive=True)
                        made.add(under)
                    with fs.open_output_stream(f"{at}/{under}/{p}") as out:
                        out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    some.select(F.concat(F.lit("part"), part.cast("string"), F.lit("/"), "path").alias("path"), "content").mapInArrow(each, "path string").count()
    return root


def folder_findings(spark, sf_dir):
    """Findings of the base grid in a folder of files: listed, pruned, read, cut to the bytes that are looked at, their languages told."""
    rows = bounded(scan_folder(spark, written_folder(spark, sf_dir))).drop("truncated").withColumn("path", F.regexp_replace("path", "^[^/]*/", ""))
    return scan.grid(rows, catalog.BASE, "regex", ("language",)).select("path", "language", "rule_id", "severity", "line", "column", "match_length", "excerpt")


def repo_findings(spark, sf_dir):
    """Findings of both text engines, of those with one rule, line and path the last; clean files stay with a null rule, at line 0."""
    f = files(spark, sf_dir)
    both = scan.grid(f, catalog.BASE, "regex").withColumn("step", F.lit(0)).unionByName(scan.grid(f, catalog.LANGUAGE, "language").withColumn("step", F.lit(1)))
    kept = scan.last_wins(both.select("path", "rule_id", "line", "step", "ord", "column", "severity", "engine"), ["path", "rule_id", "line"], ["step", "ord", "column"])
    return scan.include_clean(f.select("path"), kept.select("path", "rule_id", "line", "column", "severity", "engine"), True).na.fill(0, ["line", "column"])


def code_audits(spark, sf_dir):
    """The audit of every file by all engines: score, level, verdict, issues, who found them, and the gravest rule."""
    rows = Engine(spark).audit_code_safety(files(spark, sf_dir))
    return rows.select("file_id", "risk_score", "risk_level", "verdict", "issue_count", "engines", F.coalesce(F.get("issues", F.lit(0))["rule_id"], F.lit("")).alias("gravest_rule"))


_TENANTS = "(VALUES (1, 'strict', 'CRITICAL,HIGH', 40), (2, 'pci', 'MEDIUM,HIGH', 10), (3, 'nosuch', 'CRITICAL', 1000000000), (4, 'default', 'CRITICAL', 5), (5, 'soc2', 'LOW', 50)) AS t(id, pack, fail_on, max_risk)"
_JUDGED = f"""{grids._RISK}, ruled AS (SELECT s.file_id, s.file_id % 10 AS tenant_id, coalesce(t.pack, 'default') AS pack, coalesce(t.fail_on, 'CRITICAL') AS fail_on, coalesce(t.max_risk, 100) AS max_risk, s.risk_score FROM scored s LEFT JOIN {_TENANTS} ON s.file_id % 10 = t.id),
blocked AS (SELECT r.*, (SELECT count(*) FROM kept k WHERE k.file_id = r.file_id AND list_contains(string_split(r.fail_on, ','), k.severity)) AS blocking FROM ruled r),
said AS (SELECT *, concat_ws('; ', CASE WHEN blocking > 0 THEN blocking || ' issue(s) at fail severity [''' || array_to_string(list_sort(string_split(fail_on, ',')), ''', ''') || ''']' END, CASE WHEN risk_score > max_risk THEN 'risk_score ' || risk_score || ' exceeds max_risk_score ' || max_risk END) AS r FROM blocked),
judged AS (SELECT file_id, tenant_id, pack, blocking, CASE WHEN r = '' AND risk_score >= 40 THEN 'upstream security_verdict=REJECTED' ELSE r END AS reasons FROM said)"""
_CHAIN = gates.ORACLES["requests_status_chain"]
_ANSWERED = _CHAIN.replace("SELECT g.tenant_id, CASE WHEN user_id", "SELECT g.event_id, g.tool, g.value, CASE WHEN user_id").replace(", count(*) AS n FROM granted", " FROM granted").removesuffix(" GROUP BY ALL")
_METRICS = f"""WITH a AS ({_ANSWERED}), b AS (SELECT tool, value, CASE WHEN status = 'OK' AND event_id % 13 = 0 THEN 'ERROR' ELSE status END AS status, status = 'OK' AND event_id % 17 = 0 AS denied FROM a)
SELECT count(*) FILTER (status IN ('OK', 'ERROR')) AS tool_calls, count(*) FILTER (status = 'ERROR') AS tool_errors, count(*) FILTER (status = 'AUTH_FAILED') AS auth_failures, count(*) FILTER (status = 'RATE_LIMITED') AS rate_limited,
count(*) FILTER (denied) AS policy_denies, round(avg(value) FILTER (status IN ('OK', 'ERROR')), 2) AS avg_latency_ms, (SELECT string_agg(tool || '=' || n, ',' ORDER BY tool) FROM (SELECT tool, count(*) AS n FROM b WHERE status IN ('OK', 'ERROR') GROUP BY tool)) AS by_tool FROM b"""
_ROLES = """SELECT CASE WHEN user_id % 50 <> 0 THEN user_id % 7 ELSE -1 END AS tenant_id, CASE WHEN user_id % 50 = 0 THEN 'scanner' WHEN user_id % 4 = 0 THEN 'admin' WHEN user_id % 4 = 1 THEN 'viewer' ELSE 'scanner' END AS role, user_id % 50 <> 0 AS known, count(*) AS n FROM events GROUP BY ALL"""
_LANG = f"({grids._select('SELECT * FROM findings', catalog.LANGUAGE, engine='language')})"
_VULNERABLE = supply.ORACLES["inventory_vulnerabilities"]
_BUDGET = grids._select(f""", r AS (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 407.84 ELSE 1702.44 END AS burn FROM files), g AS (SELECT file_id, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, arg_min(rule_id, ({grids._WEIGHT.replace("'CRITICAL' THEN 40 WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 10 WHEN 'LOW' THEN 4 ELSE 1", "'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4")}, line, rule_id, "column")) AS first FROM findings GROUP BY file_id)
SELECT r.file_id, CASE WHEN file_id % 2 = 0 AND contains(content, 'm5.xlarge') THEN '$407.84' WHEN file_id % 2 = 1 THEN '$1,702.44' ELSE '$0.00' END AS projected_monthly_burn, file_id % 2 = 1 AS budget_limit_exceeded, coalesce(n, 0) AS security_issue_count, first AS gravest_rule,
CASE WHEN coalesce(c, 0) > 0 OR file_id % 2 = 1 THEN 'REJECTED' WHEN coalesce(h, 0) > 0 THEN 'REVIEW_REQUIRED' ELSE 'APPROVED' END AS verdict FROM r LEFT JOIN g USING (file_id) JOIN files USING (file_id)""", catalog.IAC, "language = 'terraform'", None, "plain")

QUERIES = {f.__name__: f for f in (policy_reasons, compliance_evidence, key_roles, gateway_metrics, risk_with_fallback, severity_by_language, vulnerability_rollup, infra_budget, folder_findings, repo_findings, code_audits)}
ORACLES = {
    "policy_reasons": grids._select(f"{_JUDGED} SELECT file_id, tenant_id, pack, blocking, CASE WHEN reasons = '' THEN 'ALLOW' ELSE 'DENY' END AS decision, reasons FROM judged"),
    "compliance_evidence": grids._select(f"{_JUDGED} SELECT file_id % 3 AS tenant_id, count(*) FILTER (reasons = '') AS allows, count(*) FILTER (reasons <> '') AS denies FROM (SELECT *, row_number() OVER (PARTITION BY file_id % 3 ORDER BY file_id DESC) AS k FROM judged) WHERE k <= 100 GROUP BY 1"),
    "key_roles": _ROLES,
    "gateway_metrics": _METRICS,
    "risk_with_fallback": grids._select(f"{grids._RISK}, l AS (SELECT file_id, sum({grids._WEIGHT}) AS w FROM {_LANG} GROUP BY file_id) SELECT s.file_id, s.path, CAST(CASE WHEN s.risk_score = 0 THEN coalesce(w, 0) ELSE s.risk_score END AS BIGINT) AS risk_score, s.risk_score = 0 AND coalesce(w, 0) > 0 AS fallback FROM scored s LEFT JOIN l USING (file_id)"),
    "severity_by_language": grids._select(f", every AS (SELECT language, severity, rule_id FROM findings JOIN files USING (file_id) UNION ALL SELECT 'dependency', severity, rule_id FROM ({_VULNERABLE})) SELECT language, severity, CAST(grouping(language, severity) AS INT) AS level, count(*) AS findings, count(DISTINCT rule_id) AS rules FROM every GROUP BY ROLLUP (language, severity)"),
    "vulnerability_rollup": f"WITH {supply._FOUND}, v AS (SELECT project, count(*) AS n, count(DISTINCT path) AS p, count(*) FILTER (severity = 'CRITICAL') AS c FROM ({_VULNERABLE}) GROUP BY project) SELECT f.project, count(*) AS packages_discovered, any_value(coalesce(p, 0)) AS packages_with_vulns, any_value(coalesce(v.n, 0)) AS total_vulns, any_value(coalesce(c, 0)) AS critical_vulns FROM found f LEFT JOIN v USING (project) GROUP BY f.project",
    "infra_budget": _BUDGET,
    "folder_findings": grids._select('SELECT path, language, rule_id, severity, line, "column", match_length, excerpt FROM findings JOIN files USING (file_id, path)'),
    "code_audits": grids._select(f"""{hybrid._ENGINES}, a AS (SELECT file_id, CAST(least(sum({grids._WEIGHT}), 999) AS BIGINT) AS risk, count(*) AS n, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, arg_min(rule_id, ({hybrid._RANK}, line, rule_id)) AS g FROM every GROUP BY file_id)
SELECT f.file_id, coalesce(risk, 0) AS risk_score, {grids._LEVEL.format('coalesce(risk, 0)')} AS risk_level, CASE WHEN coalesce(risk, 0) >= 40 THEN 'REJECTED' ELSE 'APPROVED' END AS verdict, coalesce(n, 0) AS issue_count, coalesce(engines, '') AS engines, coalesce(g, '') AS gravest_rule FROM files f LEFT JOIN a USING (file_id)"""),
    "repo_findings": grids._select(f""", b AS (SELECT 0 AS step, * FROM findings UNION ALL SELECT 1, * FROM {_LANG}), k AS (SELECT path, rule_id, line, "column", severity, CASE step WHEN 0 THEN 'regex' ELSE 'language' END AS engine FROM b QUALIFY row_number() OVER (PARTITION BY path, rule_id, line ORDER BY step DESC, ord DESC, "column" DESC) = 1)
SELECT f.path, rule_id, coalesce(line, 0) AS line, coalesce("column", 0) AS "column", severity, engine FROM files f LEFT JOIN k USING (path)"""),
}
