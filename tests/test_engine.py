"""The tools together, over a folder of files, texts, and nothing."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from sieveline.engine import Engine, own_rules

PY = "import os\ncmd = input()\nos.system(cmd)\n"


@pytest.fixture
def root(tmp_path):
    for path, text in {"app/main.py": PY, "app/clean.py": "x = 1\n", "web/a.js": "eval(x)\n", "main.tf": 'acl = "public-read"\ninstance = "m5.large"\nother = "t3.huge"\n', "Dockerfile": "FROM a:latest\nUSER root\n", "requirements.txt": "Flask==2.0.1\nplain\n", "node_modules/x.js": "eval(x)"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return str(tmp_path)


@pytest.fixture
def engine(spark, tmp_path_factory):
    known = spark.createDataFrame([("PyPI", "Flask", "2.0.1", "2099-0001", "CVSS 9.1", None)], "ecosystem string, name string, version string, id string, score string, stated string")
    rules = tmp_path_factory.mktemp("rules")
    (rules / "own.json").write_text(json.dumps({"rules": [{"id": "OWN", "pattern": "FROM", "languages": ["dockerfile"], "severity": "low"}]}))
    return Engine(spark, own_rules(spark, str(rules)), known, str(tmp_path_factory.mktemp("history")))


def test_a_repository_from_end_to_end(spark, engine, root):
    out = engine.full_pipeline(root)
    rows = {r["path"]: r for r in out["files"].collect()}
    assert set(rows) == {"app/main.py", "app/clean.py", "web/a.js", "main.tf", "Dockerfile", "requirements.txt"}
    assert rows["app/clean.py"]["issue_count"] == 0 and rows["app/clean.py"]["issues"] == [] and rows["app/clean.py"]["verdict"] == "APPROVED"
    main = rows["app/main.py"]
    assert {i["rule_id"] for i in main["issues"]} >= {"TAINT-002", "AST-005"}
    assert main["verdict"] == "REJECTED" and "taint" in main["engines"] and [i["place"] for i in main["issues"]] == list(range(1, len(main["issues"]) + 1))
    assert {i["rule_id"] for i in rows["Dockerfile"]["issues"]} == {"OWN"}
    total = out["summary"].first()
    assert total["files_scanned"] == 6 and total["verdict"] == "REJECTED" and total["issue_count"] == sum(r["issue_count"] for r in rows.values())
    assert [(r["name"], r["vulnerabilities"]) for r in out["dependencies"].orderBy("name").collect()] == [("Flask", ["CVE-2099-0001"]), ("plain", [])]
    assert json.loads(out["sbom"].first()["document"])["specVersion"] == "1.5"
    assert len(json.loads(out["sarif"].first()["document"])["runs"][0]["results"]) == total["issue_count"]
    assert out["fixes"].count() == total["issue_count"] and out["fixes"].where("diff IS NOT NULL").count() > 0
    assert engine.scan_repository(root).count() == 3 and engine.scan_repository(root, most_files=1, include_clean=True).count() == 1


def test_what_changed(spark, engine, root):
    diff = "diff --git a/web/a.js b/web/a.js\n--- a/web/a.js\n+++ b/web/a.js\n@@ -0,0 +1 @@\n+eval(x)\n"
    changes = spark.createDataFrame([(1, diff)], "diff_id long, text string")
    assert [r["path"] for r in engine.scan_git_diff(root, changes).collect()] == ["web/a.js"]
    assert engine.full_pipeline(root, changes.where("false"), dependencies=False, fixes=False, sbom=None)["summary"].first()["files_scanned"] == 0


def test_single_texts(spark, engine):
    r = engine.audit_code_safety(engine.text("import os\nos.system(input())", language="python")).first()
    assert r["verdict"] == "REJECTED" and r["language"] == "python" and not r["truncated"]
    assert engine.audit_code_safety(engine.text(None)).first()["issue_count"] == 0
    long = engine.audit_code_safety(engine.text("x\n" * 300_000 + "eval(x)", "a.js")).first()
    assert long["truncated"] and long["issue_count"] == 0
    tf = engine.text('acl = "public-read"\nx = "m5.large"\ny = "t3.huge"', "main.tf")
    c = engine.audit_cloud_cost(tf).first()
    assert c["estimated_monthly_usd"] == 69.84 and c["hints"] == ["t3.huge"] and c["items"][0]["sku"] == "m5.large"
    assert engine.audit_infra_security(tf).first()["verdict"] == "REJECTED" and engine.audit_infra_security(engine.text("", "a.tf")).first()["projected_monthly_burn"] == "$0.00"
    assert {r["rule_id"] for r in engine.audit_container_config(engine.text("FROM a:latest\nUSER root\n", "Dockerfile")).collect()} == {"DKR-001", "INFRA-001"}


def test_status_plugins_and_history(spark, engine):
    status = {r["engine"]: r["rules"] for r in engine.engine_status().collect()}
    assert status["base"] == 16 and status["language"] == 23 and status["custom"] == 1 and [r["rule_id"] for r in engine.list_plugins().collect()] == ["OWN"]
    runs = spark.createDataFrame([(i, datetime.datetime(2024, 1, i + 1), i % 2) for i in range(4)], "run_id long, ts timestamp, tenant_id long")
    engine.record(runs)
    assert [r["run_id"] for r in engine.scan_history(2).collect()] == [3, 2] and [r["run_id"] for r in engine.scan_history(tenant_id=0).collect()] == [2, 0]
    with pytest.raises(ValueError):
        Engine(spark).scan_history()
    score = engine.security_score(engine.findings(engine.text("eval(x)", "a.js")).withColumn("all", F.lit(1)), ["all"]).first()
    assert score["score"] == 50 and score["grade"] == "D"
