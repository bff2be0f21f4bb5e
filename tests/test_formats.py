"""Rule folders and SARIF folders as data sources of a session."""

import json

import pytest
from pyspark.sql import functions as F

from sieveline.operators import custom
from sieveline.sources import formats, sinks


@pytest.fixture(scope="module")
def session(spark):
    formats.register(spark)
    return spark


def test_rules_are_rows(session, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.json").write_text(json.dumps([{"id": "A-1", "pattern": "foo", "severity": "high", "languages": ["Python"]}, {"id": "A-2", "pattern": "("}, "no rule"]))
    (tmp_path / "deep/b.json").write_text(json.dumps({"rules": [{"id": "B-1", "query": "bar", "enabled": False}, {"name": "no id", "languages": "go"}]}))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "_old.json").write_text(json.dumps([{"id": "O", "pattern": "x"}]))
    (tmp_path / "notes.txt").write_text("[]")
    rows = session.read.format(formats.RULES).load(f"file://{tmp_path}")
    got = [tuple(r) for r in rows.orderBy("path", "place").select("path", "place", "id", "severity", "pattern", "enabled", "languages").collect()]
    assert got == [("a.json", 0, "A-1", "HIGH", "foo", True, ["Python"]), ("a.json", 1, "A-2", "MEDIUM", "(", True, None), ("deep/b.json", 0, "B-1", "MEDIUM", "bar", False, None), ("deep/b.json", 1, None, "MEDIUM", None, True, ["go"])]
    assert [r.id for r in custom.rules_of(session, (r.asDict() for r in rows.orderBy("path", "place").toLocalIterator()))] == ["A-1"]
    some = session.read.format(formats.RULES).option("severity", "MEDIUM").option("files", '["deep/b.json", "none.json"]').load(f"file://{tmp_path}")
    assert [r["id"] for r in some.where("id IS NOT NULL").collect()] == ["B-1"] and some.count() == 2
    assert session.read.format(formats.RULES).option("files", "none.json").load(f"file://{tmp_path}").count() == 0


def test_options_reach_the_reader(tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.sarif").write_text('{"runs": []}')
    reader = formats.SarifReader({"path": str(tmp_path), "rule_id": '["A", "B"]', "files": "b.sarif"}, ["path", "rule_id"])
    assert reader.takes("rule_id", "A") and not reader.takes("rule_id", None) and reader.takes("level", None)
    assert [p.paths for p in reader.partitions()] == [["b.sarif"]]


def test_a_folder_is_cut_by_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "PART_BYTES", 100)
    for i in range(5):
        (tmp_path / f"{i}.sarif").write_text("x" * (150 if i == 2 else 40))
    assert [p.paths for p in formats.SarifReader({"path": str(tmp_path)}, []).partitions()] == [["0.sarif", "1.sarif"], ["2.sarif"], ["3.sarif", "4.sarif"]]


def found(spark, rows):
    return spark.createDataFrame(rows, "file_id int, rule_id string, severity string, path string, line int, column int, excerpt string, title string")


def test_documents_come_back(session, tmp_path):
    root = f"file://{tmp_path}/out"
    rows = found(session, [(1, "R2", "LOW", "a\\b.py", 3, 1, "x = \"é\n\"", "Two"), (1, "R1", "CRITICAL", "a.py", 0, 0, "", "One"), (1, "R1", "CRITICAL", "a.py", 0, 0, "", "One"), (2, "R1", "HIGH", "c.py", 9, 4, None, "One")])
    sinks.sarif(rows, ["file_id"]).write.format(formats.SARIF).mode("append").save(root)
    back = session.read.format(formats.SARIF).load(root)
    got = sorted(tuple(r) for r in back.select("rule_id", "level", "severity", "uri", "line", "column", "excerpt").na.fill("").collect())
    assert got == [("R1", "error", "CRITICAL", "a.py", 1, 1, ""), ("R1", "error", "CRITICAL", "a.py", 1, 1, ""), ("R1", "error", "HIGH", "c.py", 9, 4, ""), ("R2", "note", "LOW", "a/b.py", 3, 1, "x = \"é\n\"")]
    assert back.where("level = 'note' AND line > 2").count() == 1 and back.where("level = 'note' AND line > 3").count() == 0
    assert back.count() == 4 and back.where("level = 'note'").union(back.where("level = 'error'")).count() == 4
    assert session.read.format(formats.SARIF).option("level", '["note", "error"]').option("rule_id", "R2").load(root).count() == 1
    sinks.sarif(rows.where("file_id = 2"), ["file_id"]).write.format(formats.SARIF).mode("append").save(root)
    assert session.read.format(formats.SARIF).load(root).count() == 5
    sinks.sarif(rows.where("file_id = 2"), ["file_id"]).write.format(formats.SARIF).mode("overwrite").save(root)
    assert session.read.format(formats.SARIF).load(root).count() == 1
    assert not [p for p in (tmp_path / "out").iterdir() if p.is_dir()]


def test_odd_documents(session, tmp_path):
    root = f"file://{tmp_path}/odd"
    texts = session.createDataFrame([(None, 1), ('{\n"runs": [{"results": [{}]}]}', 2), ("[]", 3), ("not json", 4), ('{"runs": [null, {"results": [{"ruleIndex": 0, "message": 5}, null], "tool": {"driver": {"rules": [{"id": "Q", "defaultConfiguration": {"level": "note"}}]}}}]}', 5)], "document string, path int")
    texts.write.format(formats.SARIF).mode("append").save(root)
    rows = session.read.format(formats.SARIF).load(root)
    assert sorted((str(r["rule_id"]), str(r["level"]), r["problem"] is not None) for r in rows.collect()) == [("None", "None", True), ("None", "None", True), ("None", "warning", False), ("None", "warning", False), ("Q", "note", False)]
    texts.limit(0).write.format(formats.SARIF).mode("append").save(f"file://{tmp_path}/none")
    assert session.read.format(formats.SARIF).load(f"file://{tmp_path}/none").count() == 0


def test_a_failed_write_leaves_nothing(session, tmp_path):
    root = tmp_path / "failed"
    bad = session.range(4).repartition(2).select(F.when(F.col("id") == 3, "{\nbroken").otherwise('{"runs": []}').alias("document"))
    with pytest.raises(Exception, match="(?i)json|expecting"):
        bad.write.format(formats.SARIF).mode("append").save(f"file://{root}")
    assert not root.exists() or not list(root.rglob("*.sarifl"))
