"""Queries of the control plane, redaction, inventory and incremental scans, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions.spans import redacted, sanitised
from sieveline.operators import catalog, control, cost, languages, scan
from sieveline.plans import grids
from sieveline.plans.corpus import FILES_SQL, files, spread, table
from sieveline.sources.shared import saved


def _policy(spark, sf_dir):
    kept = saved(scan.collapsed(grids.base_findings(spark, sf_dir)).select("file_id", "severity"), "findings")
    return control.evaluate_policy(scan.risk_by_file(files(spark, sf_dir), kept).select("file_id", "risk_score"), kept.groupBy("file_id", "severity").agg(F.count("*").alias("n")), control.packs(spark))


def policy_decisions(spark, sf_dir):
    return _policy(spark, sf_dir)


def policy_by_pack(spark, sf_dir):
    return _policy(spark, sf_dir).groupBy("pack").agg(F.count_if(F.col("decision") == "ALLOW").alias("allowed"), F.count_if(F.col("decision") == "DENY").alias("denied"))


def _requests(spark, sf_dir):
    return control.requests(table(spark, sf_dir, "events"))


def tool_authorization(spark, sf_dir):
    return control.authorised(_requests(spark, sf_dir)).groupBy("role", "tool").agg(F.count("*").alias("requests"), F.count_if("granted").alias("granted"))


def rate_limit_decisions(spark, sf_dir):
    return control.token_bucket(table(spark, sf_dir, "events"), "user_id", 2, 2).groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("denied"))


def quota_running(spark, sf_dir):
    return control.running_quota(_requests(spark, sf_dir), 500)


def credit_ledger(spark, sf_dir):
    return control.ledger(_requests(spark, sf_dir), 10_000)


def tool_metrics(spark, sf_dir):
    return control.metrics(control.authorised(_requests(spark, sf_dir)))


def audit_recent(spark, sf_dir):
    """The newest events of a tenant, as an audit log's ring shows them: a top-k report."""
    return _requests(spark, sf_dir).where("tenant_id = 3").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "tool", "role")


def path_sandbox(spark, sf_dir):
    return control.sandboxed(files(spark, sf_dir), ["src/src1", "src/src2"])


def _keyed(spark, sf_dir):
    """Requests with an api key and a path: every 50th subject's key is withdrawn, every 70th has none, every ninth path climbs out of its root, every eleventh is another tenant's."""
    asked = _requests(spark, sf_dir)
    key = F.when(F.col("user_id") % 70 != 0, F.concat(F.lit("k"), F.col("user_id").cast("string")))
    owner = F.when(F.col("event_id") % 11 == 0, (F.col("tenant_id") + 1) % 10).otherwise(F.col("tenant_id"))
    path = F.concat(F.lit("/srv/t"), owner.cast("string"), F.when(F.col("event_id") % 9 == 0, "/../etc").otherwise("/repo"))
    users = asked.select("user_id").distinct()
    keys = users.select(F.sha2(F.concat(F.lit("k"), F.col("user_id").cast("string")), 256).alias("key_sha256"), (F.col("user_id") % 50 != 0).alias("active"))
    return asked.withColumns({"api_key": key, "path": path}), keys


def answered(spark, sf_dir):
    """Every request with its status: the first gate that refuses it. All five gates see all requests."""
    asked, keys = _keyed(spark, sf_dir)
    tenants = spark.createDataFrame([(i, [f"/srv/t{i}/", "/elsewhere"]) for i in range(10)], "tenant_id long, roots array<string>")
    asked = control.in_sandbox(control.authorised(control.authenticated(asked, keys)), ["/srv"], tenants)
    quota = control.running_quota(_requests(spark, sf_dir), 500).select("event_id", F.col("admitted").alias("in_quota"))
    rate = control.token_bucket(_requests(spark, sf_dir), ["tenant_id", "user_id"], 2, 2).select("event_id", F.col("admitted").alias("in_rate"))
    status = control.statuses("known", "granted", "in_rate", "in_quota", "in_sandbox")
    return asked.join(rate, "event_id").join(quota, "event_id").select("event_id", "ts", "tenant_id", "tool", "value", status.alias("status"))


def requests_status_chain(spark, sf_dir):
    return answered(spark, sf_dir).groupBy("tenant_id", "status").agg(F.count("*").alias("n"))


def access_reasons(spark, sf_dir):
    """Why requests are refused, with a tool blocked for all, one denied to tenant 1 and a list of tools for tenant 2."""
    tenants = spark.createDataFrame([(1, [], ["scan_history"]), (2, ["audit_code_safety", "scan_history"], None)], "tenant_id long, allowed array<string>, denied array<string>")
    rows = control.authorised(_requests(spark, sf_dir), ("manage_tenant",), tenants)
    return rows.groupBy("tenant_id", F.coalesce("reason", F.lit("granted")).alias("reason")).agg(F.count("*").alias("n"))


def secret_shapes_by_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.regexp_count("text", F.lit(catalog.LOG_SHAPES)).alias("hits"))
    return d.groupBy("lang").agg(F.sum("hits").cast("long").alias("hits"), F.count_if(F.col("hits") > 0).alias("documents"))


def _redacted(spark, sf_dir, name, key, column):
    rows = spread(table(spark, sf_dir, name).select(*key, column))
    made = rows.select(*key, redacted(F.col(column), catalog.LOG_SHAPES).alias("r")).where("r.hits > 0")
    return made.select(*key, "r.hits", F.md5(F.encode("r.text", "UTF-8")).alias("redacted_md5"))


def redact_documents(spark, sf_dir):
    return _redacted(spark, sf_dir, "documents", ["doc_id"], "text")


def redact_pages(spark, sf_dir):
    return _redacted(spark, sf_dir, "pages", ["page_id"], "html")


def redact_conversations(spark, sf_dir):
    """Turns as a log shows them: sanitised, at most 500 characters."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.md5(F.encode(sanitised(F.col("text"), catalog.LOG_SHAPES, 500), "UTF-8")).alias("logged_md5"))


def detector_vs_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(catalog.LOG_SHAPES).alias("flagged"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"))


def incremental_changed(spark, sf_dir):
    """Documents whose content hash differs from the cache, or that the cache lacks: the cache holds all but every tenth, and old texts of every seventh."""
    now = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    cache = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return now.join(cache, ["doc_id", "sha256"], "left_anti")


def language_detect(spark, sf_dir):
    """Language of each file by its name, or by its first line where the name says nothing."""
    f = files(spark, sf_dir)
    detected = languages.detected(F.col("path"), F.col("content"))
    return f.select("file_id", detected.alias("detected"), (detected == F.col("language")).alias("agrees"))


def cost_line_items(spark, sf_dir):
    """Priced resources of infrastructure files."""
    f = files(spark, sf_dir).where("language = 'terraform'").withColumn("provider", F.lit("aws"))
    return cost.line_items(f).select("file_id", "sku", "quantity", F.col("monthly_usd"), "line")


def cost_hints(spark, sf_dir):
    """Names of instance classes that the catalog does not price."""
    f = files(spark, sf_dir).where("language = 'terraform'").withColumn("provider", F.lit("aws"))
    return cost.unpriced(f)


def infra_gate(spark, sf_dir):
    """Cost and findings of infrastructure files together: over budget or critical is rejected, high is for review."""
    f = files(spark, sf_dir).where(F.col("language").isin("terraform", "yaml", "dockerfile"))
    cost = cost_line_items(spark, sf_dir).groupBy("file_id").agg(F.round(F.sum("monthly_usd"), 2).alias("monthly_usd"))
    found = scan.grid(f, catalog.IAC, "iac", most=None).groupBy("file_id").agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"))
    rows = f.select("file_id").join(cost, "file_id", "left").join(found, "file_id", "left").na.fill(0)
    verdict = F.when((F.col("critical") > 0) | (F.col("monthly_usd") > 400), "REJECTED").when(F.col("high") > 0, "REVIEW_REQUIRED").otherwise("APPROVED")
    return rows.select("file_id", "monthly_usd", "critical", "high", verdict.alias("verdict"))


def sbom_components(spark, sf_dir):
    """Components of requirement lines made from parts: name, version, package URL; the first of equal ones."""
    lines = table(spark, sf_dir, "part").select(F.concat(F.lower(F.regexp_replace("p_name", "[^A-Za-z]+", "-")), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("=="), (F.col("p_partkey") % 5).cast("string"), F.lit(".0"))).otherwise("")).alias("line"), "p_partkey")
    parsed = lines.select(F.regexp_extract("line", r"^([A-Za-z0-9_.-]+?)(?:(==|>=|<=|~=)(.+))?$", 1).alias("name"), F.regexp_extract("line", r"^([A-Za-z0-9_.-]+?)(?:(==|>=|<=|~=)(.+))?$", 3).alias("version"), "p_partkey")
    kept = parsed.groupBy("name", "version").agg(F.min("p_partkey").alias("first_line"))
    return kept.select("name", "version", "first_line", F.concat(F.lit("pkg:pypi/"), "name", F.when(F.col("version") != "", F.concat(F.lit("@"), "version")).otherwise("")).alias("purl"))


_TOOL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in control.TOOL_OF_EVENT.items()) + " END"
_ROLE = "CASE user_id % 4 " + " ".join(f"WHEN {i} THEN '{r}'" for i, (r, _) in enumerate(control.ROLES)) + " END"
#: Effective tools, written out: what a viewer, a scanner, an operator and an admin may call.
_TOOLS = {
    "viewer": "enterprise_health enterprise_policy_status export_sarif generate_sbom",
    "scanner": "enterprise_health enterprise_policy_status export_sarif generate_sbom audit_code_safety audit_cloud_cost audit_infra_security audit_container_config scan_repository scan_git_diff scan_dependencies suggest_fixes full_pipeline evaluate_policy list_plugins engine_status security_score scan_history",
}
_TOOLS["operator"] = _TOOLS["scanner"] + " compliance_report list_audit_events"
_TOOLS["admin"] = _TOOLS["operator"] + " manage_tenant reload_enterprise_config issue_access_token"
_MATRIX = "(VALUES " + ", ".join(f"('{r}', '{t}')" for r, ts in _TOOLS.items() for t in ts.split()) + ") AS m(role, tool)"
_ASKED = f"asked AS (SELECT e.*, user_id % 10 AS tenant_id, {_TOOL} AS tool, {_ROLE} AS role FROM events e), granted AS (SELECT a.*, m.role IS NOT NULL AS granted FROM asked a LEFT JOIN {_MATRIX} ON a.role = m.role AND a.tool = m.tool)"
_QUOTA = "quota AS (SELECT event_id, tenant_id, count(*) OVER (PARTITION BY tenant_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM asked)"
_BUCKET = """ordered AS (SELECT event_id, user_id, epoch_us(ts) / 86400000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
bucket AS (SELECT user_id, event_id, k, t, TRUE AS admitted, 1.0::DOUBLE AS tokens FROM ordered WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.k, o.t, least(2.0, b.tokens + (o.t - b.t) * 2.0) >= 1.0, least(2.0, b.tokens + (o.t - b.t) * 2.0) - CASE WHEN least(2.0, b.tokens + (o.t - b.t) * 2.0) >= 1.0 THEN 1.0 ELSE 0.0 END
  FROM bucket b JOIN ordered o ON o.user_id = b.user_id AND o.k = b.k + 1)"""
_SHAPE = r"""(?i)(?:(?:sk|pk|rk|ak|api|key|token|secret|password|passwd|pwd|bearer)[-_a-z0-9]*\s*[:=]\s*["'']?[^\s"''\\]{8,}["'']?|AKIA[0-9A-Z]{16}|[A-Za-z0-9+/]{32,}={0,2}|[A-Fa-f0-9]{32,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|ghp_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,})"""
_PACKS = "(VALUES " + ", ".join(f"('{p}', '{s}', {m})" for p, s, m in control.PACKS) + ") AS g(pack, fail_on, max_risk)"
_DECIDED = f"""{grids._RISK}, decided AS (SELECT s.file_id, g.pack, s.risk_score, (SELECT count(*) FROM kept k WHERE k.file_id = s.file_id AND list_contains(string_split(g.fail_on, ','), k.severity)) AS blocking, g.max_risk FROM scored s CROSS JOIN {_PACKS}),
gated AS (SELECT file_id, pack, risk_score, blocking, CASE WHEN blocking > 0 OR risk_score > max_risk THEN 'DENY' ELSE 'ALLOW' END AS decision FROM decided)"""


def _clean_sql(column: str) -> str:
    """column with each match masked: matches are marked, the text split at the marks, odd parts masked."""
    parts = f"string_split(regexp_replace({column}, '({_SHAPE})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"array_to_string(list_transform({parts}, lambda v, i: CASE WHEN i % 2 = 1 THEN v WHEN length(v) <= 8 THEN repeat('*', length(v)) ELSE left(v, 2) || repeat('*', least(length(v) - 4, 12)) || right(v, 2) END), '')"


def _redact_sql(name: str, key: str, column: str) -> str:
    return f"SELECT {key}, CAST(len(regexp_extract_all({column}, '{_SHAPE}')) AS INT) AS hits, md5({_clean_sql(column)}) AS redacted_md5 FROM {name} WHERE regexp_matches({column}, '{_SHAPE}')"


#: Worked out by hand for the snippet with resources: name, quantity, price, line (the document's line comes before it).
_COST = "cost AS (SELECT d.doc_id AS file_id, v.* FROM documents d JOIN (VALUES ('m5.xlarge', CAST(2 AS INT), 279.36::DOUBLE, CAST(3 AS INT)), ('db.m5.large', 1, 128.48, 8)) AS v(sku, quantity, monthly_usd, line) ON d.doc_id % 27 = 10 WHERE d.text IS NOT NULL)"

QUERIES = {
    f.__name__: f
    for f in (policy_decisions, policy_by_pack, tool_authorization, access_reasons, rate_limit_decisions, quota_running, credit_ledger, tool_metrics, audit_recent, path_sandbox, requests_status_chain, secret_shapes_by_lang, redact_documents, redact_pages, redact_conversations, detector_vs_labels, incremental_changed, language_detect, cost_line_items, cost_hints, infra_gate, sbom_components)
}
ORACLES = {
    "policy_decisions": grids._select(f"{_DECIDED} SELECT * FROM gated"),
    "policy_by_pack": grids._select(f"{_DECIDED} SELECT pack, count(*) FILTER (decision = 'ALLOW') AS allowed, count(*) FILTER (decision = 'DENY') AS denied FROM gated GROUP BY pack"),
    "tool_authorization": f"WITH {_ASKED} SELECT role, tool, count(*) AS requests, count(*) FILTER (granted) AS granted FROM granted GROUP BY ALL",
    "rate_limit_decisions": f"WITH RECURSIVE {_BUCKET} SELECT user_id, count(*) FILTER (admitted) AS admitted, count(*) FILTER (NOT admitted) AS denied FROM bucket GROUP BY user_id",
    "quota_running": f"WITH {_ASKED}, {_QUOTA} SELECT event_id, tenant_id, used, used < 500 AS admitted FROM quota",
    "credit_ledger": f"WITH {_ASKED}, c AS (SELECT event_id, tenant_id, ts, CAST(CASE WHEN tool = 'scan_repository' THEN floor(value * 100) ELSE 1 END AS BIGINT) AS charge FROM asked) SELECT event_id, tenant_id, charge, CAST(1000000 - sum(charge) OVER (PARTITION BY tenant_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance FROM c",
    "tool_metrics": f"WITH {_ASKED} SELECT tool, count(*) AS calls, count(DISTINCT user_id) AS subjects, round(avg(value), 6) AS mean_value, count(*) FILTER (NOT granted) AS denied FROM granted GROUP BY tool",
    "audit_recent": f"WITH {_ASKED} SELECT event_id, tool, role FROM asked WHERE tenant_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 50",
    "path_sandbox": f"SELECT file_id, path, starts_with(path, 'src/src1/') OR starts_with(path, 'src/src2/') OR path IN ('src/src1', 'src/src2') AS inside FROM ({FILES_SQL})",
    "requests_status_chain": f"""WITH RECURSIVE {_ASKED}, {_QUOTA}, {_BUCKET} SELECT g.tenant_id, CASE WHEN user_id % 70 = 0 OR user_id % 50 = 0 THEN 'AUTH_FAILED' WHEN NOT granted THEN 'FORBIDDEN' WHEN NOT admitted THEN 'RATE_LIMITED'
WHEN used >= 500 AND tool IN ('audit_code_safety', 'scan_repository') THEN 'QUOTA_EXCEEDED' WHEN (event_id % 9 = 0 OR event_id % 11 = 0) AND tool = 'scan_repository' THEN 'SANDBOX_DENIED' ELSE 'OK' END AS status, count(*) AS n FROM granted g JOIN (SELECT event_id, admitted FROM bucket) b USING (event_id) JOIN (SELECT event_id, used FROM quota) q USING (event_id) GROUP BY ALL""",
    "access_reasons": f"""WITH {_ASKED} SELECT tenant_id, CASE WHEN tool = 'manage_tenant' THEN 'blocked' WHEN tenant_id = 1 AND tool = 'scan_history' THEN 'denied' WHEN tenant_id = 2 AND tool NOT IN ('audit_code_safety', 'scan_history') THEN 'not listed' WHEN NOT granted THEN 'role' ELSE 'granted' END AS reason, count(*) AS n FROM granted GROUP BY ALL""",
    "secret_shapes_by_lang": f"SELECT lang, CAST(sum(h) AS BIGINT) AS hits, count(*) FILTER (h > 0) AS documents FROM (SELECT lang, len(regexp_extract_all(text, '{_SHAPE}')) AS h FROM documents) GROUP BY lang",
    "redact_documents": _redact_sql("documents", "doc_id", "text"),
    "redact_pages": _redact_sql("pages", "page_id", "html"),
    "redact_conversations": f"SELECT conv_id, turn, md5(CASE WHEN length(c) > 500 THEN left(c, 499) || '…' ELSE c END) AS logged_md5 FROM (SELECT conv_id, turn, {_clean_sql('text')} AS c FROM conversations)",
    "cost_hints": "SELECT doc_id AS file_id, 't3.huge' AS name FROM documents WHERE doc_id % 27 = 10 AND text IS NOT NULL",
    "detector_vs_labels": f"SELECT quality, toxic, count(*) AS documents, count(*) FILTER (regexp_matches(text, '{_SHAPE}')) AS flagged FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL",
    "incremental_changed": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0",
    "language_detect": f"SELECT file_id, language AS detected, TRUE AS agrees FROM ({FILES_SQL})",
    "cost_line_items": f"WITH files AS ({FILES_SQL}), {_COST} SELECT * FROM cost",
    "infra_gate": grids._select(f""", {_COST}, c AS (SELECT file_id, round(sum(monthly_usd), 2) AS monthly_usd FROM cost GROUP BY file_id), n AS (SELECT file_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high FROM findings GROUP BY file_id),
r AS (SELECT f.file_id, coalesce(c.monthly_usd, 0) AS monthly_usd, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high FROM files f LEFT JOIN c ON f.file_id = c.file_id LEFT JOIN n ON f.file_id = n.file_id)
SELECT *, CASE WHEN critical > 0 OR monthly_usd > 400 THEN 'REJECTED' WHEN high > 0 THEN 'REVIEW_REQUIRED' ELSE 'APPROVED' END AS verdict FROM r""", catalog.IAC, grids._INFRA_WHERE, None),
    "sbom_components": """WITH l AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z]+', '-', 'g')) AS name, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 5 AS VARCHAR) || '.0' ELSE '' END AS version FROM part)
SELECT name, version, min(p_partkey) AS first_line, 'pkg:pypi/' || name || CASE WHEN version <> '' THEN '@' || version ELSE '' END AS purl FROM l GROUP BY name, version""",
}
