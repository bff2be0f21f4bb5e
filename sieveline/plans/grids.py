"""Queries over the detector grids, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.operators import catalog, scan, structural
from sieveline.operators.catalog import Rule
from sieveline.plans.corpus import FILES_SQL, SNIPPETS, files
from sieveline.sources.shared import saved

FINDING = ["file_id", "path", "rule_id", "severity", "line", "column", "match_length", "excerpt", "truncated"]
INFRA_LANGUAGES = ("terraform", "yaml", "dockerfile")


def _masked_sql(v: str) -> str:
    return f"CASE WHEN length({v}) <= 8 THEN repeat('*', length({v})) ELSE left({v}, 2) || repeat('*', least(length({v}) - 4, 12)) || right({v}, 2) END"


def _veiled_sql(v: str) -> str:
    """Long values of a text masked: quoted ones between their quotes, bare ones whole."""
    value = "split_part(p, chr(2), 1)"
    inner = f"substr({value}, 2, length({value}) - 2)"
    pattern = r"''[A-Za-z0-9_+\-/=.]{12,}''|\"[A-Za-z0-9_+\-/=.]{12,}\"|\b[A-Za-z0-9_+/=]{32,}\b"
    quoted = f"left({value}, 1) || {_masked_sql(inner)} || right({value}, 1)"
    return f"""array_to_string(list_transform(string_split(regexp_replace({v}, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1)),
  lambda p: CASE WHEN NOT contains(p, chr(2)) THEN p WHEN left(p, 1) IN (chr(34), chr(39)) THEN {quoted} ELSE {_masked_sql(value)} END || CASE WHEN contains(p, chr(2)) THEN split_part(p, chr(2), 2) ELSE '' END), '')"""


#: Rules whose matches must not be shown, written out.
_SECRET_RULES = "('SEC-001', 'SEC-001b', 'SEC-002', 'SEC-002b', 'SEC-010', 'SEC-011', 'SEC-012')"


def _excerpt_sql(engine: str) -> str:
    """The excerpt from line (the line around a match), at (characters before it) and n (of the match)."""
    if engine == "plain":
        return "left(bare, 160)"
    near = f"""{_veiled_sql("CASE WHEN a > 40 THEN '…' || substr(raw, a - 39, 40) ELSE left(raw, a) END")} || {_masked_sql("substr(raw, a + 1, b - a)")} || {_veiled_sql("substr(raw, b + 1, 40) || CASE WHEN length(raw) > b + 40 THEN '…' ELSE '' END")}"""
    if engine == "language":
        return near
    return f"CASE WHEN rule_id IN {_SECRET_RULES} THEN {near} ELSE {_veiled_sql('left(clipped, 40)')} END"


def _rule_sql(i: int, r: Rule) -> str:
    """Findings of one rule: matches are marked, the text split at the marks, offsets summed over the parts."""
    span, before = r.sql or r.span, "" if r.sql and r.before.startswith("(?<") else r.before
    flags = f"(?{r.flags})" if r.flags else ""
    pattern = f"{flags}({before})({span})({r.after})".replace("'", "''")
    where = "" if not r.languages or "*" in r.languages else "WHERE language IN (" + ", ".join(f"'{x}'" for x in r.languages) + ")"
    unless = f"AND NOT {r.unless}" if r.unless else ""
    hit = f"regexp_extract(m, '{r.trim}')" if r.trim else "m"
    return f"""
SELECT file_id, path, {i} AS ord, '{r.id}' AS rule_id, '{r.severity}' AS severity, head, split_part(substr(content, CAST(length(head) + 1 AS INT)), chr(10), 1) AS tail, {hit} AS m FROM (
  SELECT *, right(head, 1) AS p FROM (
    SELECT file_id, path, content, i, substr(content, 1, CAST(sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INT)) AS head, split_part(part, chr(2), 1) AS m
    FROM (SELECT file_id, path, content, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
          FROM (SELECT file_id, path, content, string_split(regexp_replace(content, '{pattern}', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(1)) AS parts FROM files {where}))
  ) WHERE i > 1
) WHERE TRUE {unless}"""


def findings_sql(rules: tuple[Rule, ...], where: str = "TRUE", most: int | None = 100, engine: str = "regex") -> str:
    union = " UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(rules))
    return f"""WITH files AS (SELECT * FROM ({FILES_SQL}) WHERE {where}), hits AS ({union}),
lined AS (SELECT *, split_part(head, chr(10), -1) || tail AS line_text, CAST(length(split_part(head, chr(10), -1)) AS INT) AS ahead, regexp_replace(split_part(head, chr(10), -1) || tail, '^\\s+|\\s+$', '', 'g') AS bare FROM hits),
clipped AS (SELECT *, replace(left(line_text, 8000), chr(9), ' ') AS raw, CASE WHEN length(bare) > 160 THEN left(bare, 157) || '…' ELSE bare END AS clipped FROM lined),
placed AS (SELECT *, CAST(least(ahead, length(raw)) AS INT) AS a, CAST(greatest(least(ahead, length(raw)), least(ahead + length(m), length(line_text), length(raw))) AS INT) AS b FROM clipped),
findings AS (SELECT file_id, path, ord, rule_id, severity, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS INT) AS line,
  CAST(ahead + 1 AS INT) AS "column", CAST(length(m) AS INT) AS match_length, {_excerpt_sql(engine)} AS excerpt,
  {"FALSE" if most is None else f"count(*) OVER (PARTITION BY file_id) > {most}"} AS truncated FROM placed {"" if most is None else f"QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ord, length(head)) <= {most}"})"""


def _select(body: str, rules=catalog.BASE, where: str = "TRUE", most: int | None = 100, engine: str = "regex") -> str:
    return f"{findings_sql(rules, where, most, engine)} {body}"


_ALL = 'SELECT file_id, path, rule_id, severity, line, "column", match_length, excerpt, truncated FROM findings'
_INFRA_WHERE = "language IN ('terraform', 'yaml', 'dockerfile')"


def base_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.grid(files(spark, sf_dir), catalog.BASE, "regex")


def base_grid_findings(spark, sf_dir):
    return base_findings(spark, sf_dir).select(*FINDING)


def lang_grid_findings(spark, sf_dir):
    return scan.grid(files(spark, sf_dir), catalog.LANGUAGE, "language").select(*FINDING)


def iac_findings(spark, sf_dir):
    return scan.grid(files(spark, sf_dir).where(F.col("language").isin(*INFRA_LANGUAGES)), catalog.IAC, "iac", most=None).select(*FINDING)


def docker_findings(spark, sf_dir):
    return scan.grid(files(spark, sf_dir).where("language = 'dockerfile'"), catalog.DOCKER, "docker", most=None).select(*FINDING)


def k8s_findings(spark, sf_dir):
    return scan.grid(files(spark, sf_dir).where("language = 'yaml'"), catalog.K8S, "k8s", most=None).select(*FINDING)


def rule_hit_counts(spark, sf_dir):
    return base_findings(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count("*").alias("hits"), F.countDistinct("file_id").alias("files"))


def collapsed_findings(spark, sf_dir):
    return scan.collapsed(base_findings(spark, sf_dir)).select(*FINDING)


def risk_by_file(spark, sf_dir):
    return scan.risk_by_file(files(spark, sf_dir), scan.collapsed(base_findings(spark, sf_dir)))


def top_risky_files(spark, sf_dir):
    return risk_by_file(spark, sf_dir).orderBy(F.desc("risk_score"), "path").limit(20)


def repo_rollup(spark, sf_dir):
    kept = saved(scan.collapsed(base_findings(spark, sf_dir)).select("file_id", "severity"), "findings")
    return scan.rollup(scan.risk_by_file(files(spark, sf_dir), kept), kept)


def severity_scorecard(spark, sf_dir):
    return scan.scorecard(base_findings(spark, sf_dir), ["file_id"])


def language_rollup(spark, sf_dir):
    return risk_by_file(spark, sf_dir).groupBy("language").agg(F.count("*").alias("files"), F.sum("risk_score").alias("risk_score"), F.sum("issue_count").alias("issue_count"))


def sarif_rules(spark, sf_dir):
    """Distinct rules with the number SARIF gives them: by first appearance in catalog order."""
    return base_findings(spark, sf_dir).groupBy("rule_id").agg(F.min("ord").alias("o"), F.min("severity").alias("severity")).select("rule_id", (F.dense_rank().over(Window.orderBy("o")) - 1).alias("rule_index"), F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note").alias("level"))


def sarif_results(spark, sf_dir):
    f = base_findings(spark, sf_dir)
    mark = F.left(F.sha2(F.concat_ws("|", "rule_id", "path", F.col("line").cast("string"), "excerpt"), 256), F.lit(16))
    return f.select("rule_id", "path", "line", "column", F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note").alias("level"), mark.alias("fingerprint"))


def ast_findings(spark, sf_dir):
    """Findings of the syntax-tree rules in Python files."""
    return structural.findings(files(spark, sf_dir)).select("file_id", "rule_id", "severity", "line", "column")


def hybrid_findings(spark, sf_dir):
    """Both engines together: the base grid less what the syntax tree reports on the same line in the same family, collapsed."""
    found = structural.findings(files(spark, sf_dir))
    names = ["file_id", "rule_id", "severity", "line", "column"]
    return scan.collapsed(scan.without_twins(base_findings(spark, sf_dir), found)).select(*names).unionByName(found.select(*names))


#: Worked out by hand for each Python snippet of the corpus: rule, severity, line, column. Lines count the document's line before it.
_BY_HAND = {
    0: [("AST-005", "HIGH", 5, 5), ("AST-005", "HIGH", 6, 5), ("AST-003", "CRITICAL", 7, 12)],
    1: [("AST-010", "MEDIUM", 2, 1), ("AST-009", "HIGH", 4, 8), ("AST-006", "HIGH", 5, 8), ("AST-006", "HIGH", 6, 8)],
    4: [("AST-003", "CRITICAL", 5, 5), ("AST-003", "CRITICAL", 5, 10), ("AST-003", "CRITICAL", 5, 26)],
    16: [("AST-004", "CRITICAL", 6, 1), ("AST-004b", "HIGH", 7, 1), ("AST-003", "CRITICAL", 9, 1), ("AST-011", "MEDIUM", 10, 1), ("AST-003b", "HIGH", 11, 8), ("AST-005t", "CRITICAL", 13, 1)],
}
_AST = "SELECT d.doc_id AS file_id, v.* EXCLUDE (k) FROM documents d JOIN (VALUES " + ", ".join(f"({k}, '{r}', '{s}', CAST({n} AS INT), CAST({c} AS INT))" for k, rows in _BY_HAND.items() for r, s, n, c in rows) + f""") AS v(k, rule_id, severity, line, "column") ON d.doc_id % {len(SNIPPETS)} = v.k WHERE d.text IS NOT NULL"""
_COLLAPSED = """, kept AS (SELECT * EXCLUDE (fam) FROM (SELECT *, nullif(regexp_extract(rule_id, '^SEC-(003|004|005|006|009|010)', 1), '') AS fam FROM findings)
  QUALIFY fam IS NULL OR row_number() OVER (PARTITION BY file_id, fam, line, severity ORDER BY ord, "column") = 1)"""
_TWINLESS = """, alone AS (SELECT f.* FROM findings f WHERE NOT EXISTS (SELECT 1 FROM ast a WHERE a.file_id = f.file_id AND a.line = f.line AND regexp_extract(f.rule_id, '^SEC-(003|004|005|006|009)', 1) <> ''
  AND starts_with(a.rule_id, 'AST-' || regexp_extract(f.rule_id, '^SEC-(003|004|005|006|009)', 1))))"""
_WEIGHT = "CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 10 WHEN 'LOW' THEN 4 ELSE 1 END"
_LEVEL = "CASE WHEN {0} <= 0 THEN 'NONE' WHEN {0} < 20 THEN 'LOW' WHEN {0} < 50 THEN 'MEDIUM' WHEN {0} < 100 THEN 'HIGH' ELSE 'CRITICAL' END"
_RISK = f"""{_COLLAPSED}, scored AS (SELECT f.file_id, f.path, f.language, CAST(least(coalesce(sum({_WEIGHT}) FILTER (k.file_id IS NOT NULL), 0), 999) AS BIGINT) AS risk_score, count(k.file_id) AS issue_count
  FROM files f LEFT JOIN kept k ON f.file_id = k.file_id GROUP BY ALL)"""
_RISK_ROWS = f"SELECT file_id, path, language, risk_score, {_LEVEL.format('risk_score')} AS risk_level, issue_count, CASE WHEN risk_score >= 40 THEN 'REJECTED' ELSE 'APPROVED' END AS verdict FROM scored"
_SARIF_LEVEL = "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END"

QUERIES = {f.__name__: f for f in (risk_by_file, base_grid_findings, lang_grid_findings, iac_findings, docker_findings, k8s_findings, rule_hit_counts, collapsed_findings, top_risky_files, repo_rollup, severity_scorecard, language_rollup, sarif_rules, sarif_results, ast_findings, hybrid_findings)}
ORACLES = {
    "base_grid_findings": _select(_ALL),
    "ast_findings": _AST,
    "hybrid_findings": _select(f""", ast AS ({_AST}){_TWINLESS}{_COLLAPSED.replace("FROM findings)", "FROM alone)")} SELECT file_id, rule_id, severity, line, "column" FROM kept UNION ALL SELECT * FROM ast"""),
    "lang_grid_findings": _select(_ALL, catalog.LANGUAGE, engine="language"),
    "iac_findings": _select(_ALL, catalog.IAC, _INFRA_WHERE, None, "plain"),
    "docker_findings": _select(_ALL, catalog.DOCKER, "language = 'dockerfile'", None, "plain"),
    "k8s_findings": _select(_ALL, catalog.K8S, "language = 'yaml'", None, "plain"),
    "rule_hit_counts": _select("SELECT rule_id, severity, count(*) AS hits, count(DISTINCT file_id) AS files FROM findings GROUP BY ALL"),
    "collapsed_findings": _select(_COLLAPSED + " " + _ALL.replace("FROM findings", "FROM kept")),
    "risk_by_file": _select(f"{_RISK} {_RISK_ROWS}"),
    "top_risky_files": _select(f"{_RISK} {_RISK_ROWS} ORDER BY risk_score DESC, path LIMIT 20"),
    "repo_rollup": _select(f"""{_RISK}, total AS (SELECT count(*) AS files_scanned, count(*) FILTER (issue_count > 0) AS files_with_issues, CAST(sum(issue_count) AS BIGINT) AS issue_count, CAST(least(sum(risk_score), 99999) AS BIGINT) AS risk_score FROM scored)
SELECT files_scanned, files_with_issues, issue_count, risk_score, {_LEVEL.format('least(risk_score, 999)')} AS risk_level, CASE WHEN risk_score >= 40 OR (SELECT bool_or(severity = 'CRITICAL') FROM kept) THEN 'REJECTED' ELSE 'APPROVED' END AS verdict FROM total"""),
    "severity_scorecard": _select("""SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM (
SELECT file_id, count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (severity = 'HIGH') AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium, count(*) FILTER (severity = 'LOW') AS n_low, count(*) FILTER (severity = 'INFO') AS n_info,
CAST(greatest(0, 100 - sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 12 WHEN 'MEDIUM' THEN 5 WHEN 'LOW' THEN 2 ELSE 0 END)) AS BIGINT) AS score FROM findings GROUP BY file_id)"""),
    "language_rollup": _select(f"{_RISK} SELECT language, count(*) AS files, CAST(sum(risk_score) AS BIGINT) AS risk_score, CAST(sum(issue_count) AS BIGINT) AS issue_count FROM scored GROUP BY language"),
    "sarif_rules": _select(f"SELECT rule_id, CAST(dense_rank() OVER (ORDER BY o) - 1 AS INT) AS rule_index, {_SARIF_LEVEL} AS level FROM (SELECT rule_id, min(ord) AS o, min(severity) AS severity FROM findings GROUP BY rule_id)"),
    "sarif_results": _select(f"""SELECT rule_id, path, line, "column", {_SARIF_LEVEL} AS level, left(sha256(concat_ws('|', rule_id, path, CAST(line AS VARCHAR), excerpt)), 16) AS fingerprint FROM findings"""),
}
