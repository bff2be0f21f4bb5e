"""Queries of the software inventory and of streams, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.operators import inventory
from sieveline.plans import gates, grids
from sieveline.plans.corpus import table
from sieveline.streaming import live

#: Manifests, ~ for a line end, and the components worked out by hand: name, version, package URL.
MANIFESTS = [
    ("requirements.txt", '# pinned~-r base.txt~Flask==2.0.1~requests >= 2.5 , < 3~plain~flask==2.0.1~', [("Flask", "2.0.1", "pkg:pypi/Flask@2.0.1", "PyPI"), ("requests", "2.5", "pkg:pypi/requests@2.5", "PyPI"), ("plain", "UNKNOWN", "pkg:pypi/plain", "PyPI")]),
    ("pyproject.toml", '[project]~name = "x"~dependencies = [~  "numpy>=1.26",~  "typer",~]~', [("numpy", "1.26", "pkg:pypi/numpy@1.26", "PyPI"), ("typer", "UNKNOWN", "pkg:pypi/typer", "PyPI")]),
    ("package.json", '{"dependencies": {"left-pad": "^1.3.0"}, "devDependencies": {"jest": "~29.0.0", "left-pad": "1.3.0"}}', [("left-pad", "1.3.0", "pkg:npm/left-pad@1.3.0", "npm"), ("jest", "29.0.0", "pkg:npm/jest@29.0.0", "npm")]),
    ("go.mod", 'module example.com/x~go 1.21~require (~  github.com/pkg/errors v0.9.1~)~require golang.org/x/net v0.1.0~', [("github.com/pkg/errors", "0.9.1", "pkg:golang/github.com/pkg/errors@0.9.1", "Go")]),
    ("Cargo.toml", '[package]~name = "x"~version = "0.1.0"~[dependencies]~serde = "1.0.1"~tokio = { features = ["full"], version = "1.2" }~[dev-dependencies]~rand = "0.8"~', [("serde", "1.0.1", "pkg:cargo/serde@1.0.1", "crates.io"), ("tokio", "1.2", "pkg:cargo/tokio@1.2", "crates.io")]),
]
#: Invented advisories: ecosystem, name, version, id, score, stated severity.
ADVISORIES = [
    ("PyPI", "Flask", "2.0.1", "2099-0001", "CVSS 9.1", None), ("PyPI", "requests", "2.5", "2099-0002", "CVSS:3.1/AV:N/C:H/I:H/A:H", "high"), ("npm", "left-pad", "1.3.0", "2099-0003", None, None),
    ("crates.io", "serde", "1.0.1", "2099-0004", "cvss 3.5", "CRITICAL"), ("Go", "github.com/pkg/errors", "0.9.0", "2099-0005", "CVSS 9.9", None),
]
_SEVERITY_BY_HAND = {"2099-0001": "CRITICAL", "2099-0002": "HIGH", "2099-0003": "MEDIUM", "2099-0004": "LOW"}


def manifests(spark, sf_dir):
    """One manifest per document; a document is a project."""
    found = spark.createDataFrame([(k, name, body.replace("~29", "\0").replace("~", "\n").replace("\0", "~29")) for k, (name, body, _) in enumerate(MANIFESTS)], "k int, path string, content string")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("project"))
    return d.join(F.broadcast(found), F.col("project") % len(MANIFESTS) == F.col("k")).select("project", F.concat(F.lit("app/"), "path").alias("path"), "content")


def inventory_components(spark, sf_dir):
    return inventory.components(manifests(spark, sf_dir)).drop("place")


def inventory_vulnerabilities(spark, sf_dir):
    """Findings of known vulnerabilities. The advisories are a short fixed list here; a real table is joined by shuffle."""
    known = spark.createDataFrame(ADVISORIES, "ecosystem string, name string, version string, id string, score string, stated string")
    return inventory.vulnerable(inventory.components(manifests(spark, sf_dir)), known)


def sbom_spdx_packages(spark, sf_dir):
    """Packages of every project's SPDX document, read back from it."""
    made = inventory.spdx(inventory.components(manifests(spark, sf_dir)))
    p = F.explode(F.from_json(F.get_json_object("document", "$.packages"), "array<struct<SPDXID:string,name:string,versionInfo:string>>")).alias("p")
    return made.select("project", p).select("project", F.col("p.SPDXID").alias("spdx_id"), F.col("p.name").alias("name"), F.col("p.versionInfo").alias("version"))


def sbom_cyclonedx_components(spark, sf_dir):
    """Components of every project's CycloneDX document, read back from it."""
    made = inventory.cyclonedx(inventory.components(manifests(spark, sf_dir)))
    p = F.explode(F.from_json(F.get_json_object("document", "$.components"), "array<struct<name:string,purl:string>>")).alias("p")
    return made.select("project", F.get_json_object("document", "$.specVersion").alias("spec_version"), p).select("project", "spec_version", F.col("p.name").alias("name"), F.col("p.purl").alias("purl"))


def fix_drafts(spark, sf_dir):
    return inventory.fix_drafts(grids.base_findings(spark, sf_dir).select("file_id", "rule_id", "line", "column")).drop("guidance", "diff")


def _asked(spark, sf_dir):
    return live.request_stream(live.parquet_stream(spark, f"{sf_dir}/events.parquet"))


def stream_tool_windows(spark, sf_dir):
    """Daily calls by tool from the event stream: the windows that the watermark has closed."""
    return live.drained(live.tool_windows(_asked(spark, sf_dir)), "windows").select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("window_start") / 86400).cast("int")).cast("string").alias("day"), "tool", "calls", "denied")


def stream_token_buckets(spark, sf_dir):
    done = live.drained(live.token_buckets(_asked(spark, sf_dir), "user_id", 2, 2), "buckets")
    return done.groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("denied"))


_ROWS = [(k, i + 1, *c) for k, (_, _, cs) in enumerate(MANIFESTS) for i, c in enumerate(cs)]
_FOUND = "found AS (SELECT d.doc_id AS project, v.* FROM documents d JOIN (VALUES " + ", ".join(f"({k}, {i}, '{n}', '{v}', '{p}', '{e}')" for k, i, n, v, p, e in _ROWS) + f") AS v(k, i, name, version, purl, ecosystem) ON d.doc_id % {len(MANIFESTS)} = v.k)"
_KNOWN = "(VALUES " + ", ".join(f"('{e}', '{n}', '{v}', '{i}', '{_SEVERITY_BY_HAND[i]}')" for e, n, v, i, _, _ in ADVISORIES if i in _SEVERITY_BY_HAND) + ") AS a(ecosystem, name, version, id, severity)"
_LONGEST = "(VALUES " + ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, (t, *_) in inventory.FIXES.items()) + ") AS x(prefix, title)"

QUERIES = {f.__name__: f for f in (inventory_components, inventory_vulnerabilities, sbom_spdx_packages, sbom_cyclonedx_components, fix_drafts, stream_tool_windows, stream_token_buckets)}
ORACLES = {
    "inventory_components": f"WITH {_FOUND} SELECT project, name, version, purl, ecosystem FROM found",
    "inventory_vulnerabilities": f"WITH {_FOUND} SELECT project, 'CVE-' || id AS rule_id, severity, 'dependency:' || a.ecosystem || '/' || a.name AS path FROM found f JOIN {_KNOWN} ON f.ecosystem = a.ecosystem AND f.name = a.name AND f.version = a.version",
    "sbom_spdx_packages": f"WITH {_FOUND} SELECT project, 'SPDXRef-Package-' || i AS spdx_id, name, version FROM found",
    "sbom_cyclonedx_components": f"WITH {_FOUND} SELECT project, '1.5' AS spec_version, name, purl FROM found",
    "fix_drafts": grids._select(f"""SELECT f.file_id, f.rule_id, f.line, f."column", coalesce(best, 'Address ' || f.rule_id) AS title, CASE WHEN best IS NULL THEN 'medium' ELSE 'high' END AS confidence FROM findings f LEFT JOIN (SELECT r.rule_id, arg_max(title, length(prefix)) AS best FROM (SELECT DISTINCT rule_id FROM findings) r JOIN {_LONGEST} ON starts_with(r.rule_id, prefix) GROUP BY r.rule_id) b ON f.rule_id = b.rule_id"""),
    "stream_tool_windows": f"WITH {gates._ASKED} SELECT strftime(ts, '%Y-%m-%d') AS day, tool, count(*) AS calls, count(*) FILTER (NOT granted) AS denied FROM granted WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY ALL",
    "stream_token_buckets": gates.ORACLES["rate_limit_decisions"],
}
