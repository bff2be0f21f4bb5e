"""The library's tools as methods of one object. Each takes relations of many files, findings or runs and returns a relation, so a tool runs on one text as on all of a cluster's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import catalog, cost, custom, inventory, scan, structural, taint, trees
from sieveline.operators.catalog import Rule
from sieveline.operators.languages import detected
from sieveline.plans.hybrid import containers, hybrid
from sieveline.sources import diffs, sinks
from sieveline.sources.files import bounded, changed_only, scan_folder
from sieveline.sources.shared import saved

#: Manifests of which components are read.
MANIFESTS = ("requirements.txt", "pyproject.toml", "package.json", "go.mod", "Cargo.toml")
#: What a repository scan takes of a folder, monthly budget in USD, and fixes drafted, where the caller says nothing.
MOST_FILES, BUDGET, FIXES = 2000, 500.0, 50


class Engine:
    """Tools over a session. rules are rules of one's own, advisories(ecosystem, name, version, id, score, stated) what is known of dependencies, history where runs are kept."""

    def __init__(self, spark: SparkSession, rules: tuple[Rule, ...] = (), advisories: DataFrame | None = None, history: str | None = None):
        self.spark, self.rules, self.history = spark, tuple(rules), history
        self.advisories = spark.createDataFrame([], "ecosystem string, name string, version string, id string, score string, stated string") if advisories is None else advisories

    def text(self, content: str | None, path: str = "", language: str | None = None) -> DataFrame:
        """files(file_id, path, language, content) of one text; its language is told from the path and the text where none is named."""
        rows = self.spark.createDataFrame([(0, path, language, content)], "file_id long, path string, language string, content string")
        return rows.withColumn("language", F.coalesce("language", detected(F.col("path"), F.col("content"))))

    def findings(self, files: DataFrame) -> DataFrame:
        """Findings of all engines in files, by file and place: severity, line, rule."""
        return hybrid(files, self.rules)

    def audit_code_safety(self, files: DataFrame) -> DataFrame:
        """file_id, path, language, truncated, risk_score, risk_level, verdict, issue_count, engines, issues (array, in order) of every file; the text engine sees the first bytes of a long one."""
        cut = bounded(files)
        found = saved(self.findings(cut.drop("truncated")), "issues")
        issue = F.struct("place", "rule_id", "severity", "line", "column", "engine", "excerpt")
        by_file = found.groupBy("file_id").agg(F.array_sort(F.collect_list(issue)).alias("issues"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"))
        scored = scan.risk_by_file(files, found.select("file_id", "severity"))
        rows = scored.join(cut.select("file_id", "truncated"), "file_id").join(by_file, "file_id", "left")
        none = F.array().cast(by_file.schema["issues"].dataType)
        return rows.select("file_id", "path", "language", "truncated", "risk_score", "risk_level", "verdict", "issue_count", F.coalesce("engines", F.lit("")).alias("engines"), F.coalesce("issues", none).alias("issues"))

    def audit_cloud_cost(self, files: DataFrame, provider: str = "aws") -> DataFrame:
        """file_id, estimated_monthly_usd, items, hints (names without a price) of every file."""
        some = files.withColumn("provider", F.lit(provider))
        item = F.struct("line", "sku", "quantity", "unit_usd", "monthly_usd")
        items = cost.line_items(some).groupBy("file_id").agg(F.round(F.sum("monthly_usd"), 2).alias("estimated_monthly_usd"), F.array_sort(F.collect_list(item)).alias("items"))
        hints = cost.unpriced(some).groupBy("file_id").agg(F.array_sort(F.collect_list("name")).alias("hints"))
        return files.select("file_id").join(items, "file_id", "left").join(hints, "file_id", "left").na.fill(0.0, ["estimated_monthly_usd"])

    def audit_infra_security(self, files: DataFrame, provider: str = "aws", budget: float = BUDGET) -> DataFrame:
        """What cost.budget() says of every file."""
        found = scan.ordered(scan.grid(files, catalog.IAC, "iac", most=None), ["file_id"])
        return cost.budget(files.select("file_id"), cost.line_items(files.withColumn("provider", F.lit(provider))), found, budget)

    def audit_container_config(self, files: DataFrame) -> DataFrame:
        return containers(files)

    def folder(self, root: str, most_files: int = MOST_FILES) -> DataFrame:
        """The source files under root; where there are more than most_files, the first by path (0 or less: all)."""
        rows = scan_folder(self.spark, root)
        return rows.orderBy("path").limit(most_files) if most_files > 0 else rows

    def scan_repository(self, root: str, most_files: int = MOST_FILES, include_clean: bool = False) -> DataFrame:
        """audit_code_safety() of the files under root, clean ones only where asked."""
        rows = self.audit_code_safety(saved(self.folder(root, most_files), "files"))
        return rows if include_clean else rows.where("issue_count > 0")

    def summary(self, scanned: DataFrame) -> DataFrame:
        """One row over the rows of a scan with its clean files: files, issues, score, level and verdict."""
        return scan.rollup(scanned.select("risk_score", "issue_count"), scanned.select(F.explode("issues.severity").alias("severity")))

    def scan_git_diff(self, root: str, changes: DataFrame) -> DataFrame:
        """audit_code_safety() of the files under root that changes(diff_id, text), unified diffs, give new lines."""
        paths = diffs.diff_lines(changes).select("path").distinct().withColumn("status", F.lit("M"))
        return self.audit_code_safety(saved(changed_only(scan_folder(self.spark, root), paths), "changed"))

    def components(self, root: str) -> DataFrame:
        name = F.element_at(F.split("path", "/"), -1)
        manifests = scan_folder(self.spark, root).where(name.isin(*MANIFESTS)).select(F.lit(root).alias("project"), "path", "content")
        return saved(inventory.components(manifests), "components")

    def scan_dependencies(self, root: str) -> DataFrame:
        """project, name, version, ecosystem, purl, vulnerabilities (rule ids) of the components that manifests under root name."""
        found = self.components(root)
        path = F.concat(F.lit("dependency:"), "ecosystem", F.lit("/"), "name")
        bad = inventory.vulnerable(found, self.advisories).groupBy("path").agg(F.array_sort(F.collect_set("rule_id")).alias("vulnerabilities"))
        rows = found.withColumn("path", path).join(bad, "path", "left")
        return rows.select("project", "name", "version", "ecosystem", "purl", F.coalesce("vulnerabilities", F.array().cast("array<string>")).alias("vulnerabilities"))

    def generate_sbom(self, root: str, form: str = "cyclonedx") -> DataFrame:
        """project, document: cyclonedx or spdx."""
        return {"cyclonedx": inventory.cyclonedx, "spdx": inventory.spdx}[form](self.components(root))

    def export_sarif(self, findings: DataFrame, keys: list[str]) -> DataFrame:
        """A SARIF document for each value of keys; findings without a title have their rule's id."""
        return sinks.sarif(findings if "title" in findings.columns else findings.withColumn("title", F.col("rule_id")), keys)

    def suggest_fixes(self, findings: DataFrame, limit: int = FIXES) -> DataFrame:
        """Drafts of fixes for the first limit findings by severity, path, line and rule: a top-k report."""
        dim = F.broadcast(scan.severity_dim(self.spark).select("severity", "rank"))
        first = findings.join(dim, "severity").orderBy("rank", "path", "line", "rule_id", "column").limit(limit).drop("rank")
        return inventory.fix_drafts(first)

    def security_score(self, findings: DataFrame, keys: list[str]) -> DataFrame:
        return scan.scorecard(findings, keys)

    def record(self, runs: DataFrame) -> None:
        """Append runs(run_id, ts, tenant_id, ..) to the history."""
        sinks.append_history(runs, self._kept())

    def scan_history(self, limit: int = 50, tenant_id: int | None = None) -> DataFrame:
        return sinks.recent_runs(self.spark, self._kept(), limit, tenant_id)

    def _kept(self) -> str:
        if not self.history:
            raise ValueError("this engine keeps no history")
        return self.history

    def list_plugins(self) -> DataFrame:
        """rule_id, severity, languages, title of the rules of one's own."""
        return self.spark.createDataFrame([(r.id, r.severity, list(r.languages), r.title) for r in self.rules], "rule_id string, severity string, languages array<string>, title string")

    def engine_status(self) -> DataFrame:
        """engine, rules: how many rules each engine has."""
        counts = {name: len(rules) for name, rules in catalog.GRIDS.items()} | {"syntax": len({r[0] for r in structural._rules()}), "taint": len(taint.RULES), "tree": len(trees.RULES), "custom": len(self.rules)}
        return self.spark.createDataFrame(sorted(counts.items()), "engine string, rules int")

    def full_pipeline(self, root: str, changes: DataFrame | None = None, dependencies: bool = True, fixes: bool = True, sbom: str | None = "cyclonedx") -> dict[str, DataFrame]:
        """files, summary, sarif, and where asked dependencies, sbom and fixes of a repository, or of what changes of it."""
        scanned = saved(self.scan_git_diff(root, changes) if changes is not None else self.scan_repository(root, include_clean=True), "scanned")
        found = scanned.select("file_id", "path", F.inline("issues"))
        out = {"files": scanned, "summary": self.summary(scanned), "sarif": self.export_sarif(found.withColumn("project", F.lit(root)), ["project"])}
        if dependencies:
            out["dependencies"] = self.scan_dependencies(root)
        if sbom:
            out["sbom"] = self.generate_sbom(root, sbom)
        if fixes:
            out["fixes"] = self.suggest_fixes(found)
        return out


def own_rules(spark: SparkSession, folder: str) -> tuple[Rule, ...]:
    """Rules of the files in a folder, for an Engine."""
    return custom.load(spark, folder)
