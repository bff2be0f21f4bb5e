"""Folders, change lists, caches, rule files, hooks, data flow, sinks."""

import json

from pyspark.sql import functions as F

from sieveline.operators import catalog, custom, scan, taint
from sieveline.sources import files as source
from sieveline.sources import sinks

FILES = "file_id long, path string, language string, content string"


def test_a_folder_is_scanned(spark, tmp_path):
    root = tmp_path / "my repo"
    for name, data in {
        "a.py": b"eval(x)\n", "src/deep/B.JS": b"eval(y)", "Dockerfile": b"FROM a", "go.mod": b"module m", "src/bad.py": b"caf\xe9 = 1", "empty.py": b"", "big.py": b"x" * 600_000, "notes.txt": b"eval(z)", "run": b"eval",
        ".git/c.py": b"eval(1)", "node_modules/p/d.js": b"eval(1)", "x/.hidden/e.py": b"eval(1)", "own/f.py": b"eval(1)", ".f.py": b"1", "src/venv.py": b"2", "pkg/__init__.py": b"3", "__pycache__/g.py": b"4",
    }.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    got = {r["path"]: (r["language"], r["content"]) for r in source.scan_folder(spark, f"file://{root}", skip=("own",)).collect()}
    assert got == {"a.py": ("python", "eval(x)\n"), "src/deep/B.JS": ("javascript", "eval(y)"), "Dockerfile": ("dockerfile", "FROM a"), "go.mod": ("unknown", "module m"), "src/bad.py": ("python", "caf� = 1"), "empty.py": ("python", ""), ".f.py": ("python", "1"), "src/venv.py": ("python", "2"), "pkg/__init__.py": ("python", "3")}
    found = scan.grid(source.scan_folder(spark, str(root)), catalog.BASE, "regex")
    assert sorted(r["path"] for r in found.collect()) == ["a.py", "own/f.py", "src/deep/B.JS"]


def test_long_texts_are_cut_and_say_so(spark):
    df = spark.createDataFrame([(1, "é" * 10), (2, "abc"), (3, None)], "file_id long, content string")
    assert [(r["content"], r["truncated"]) for r in source.bounded(df, 5).orderBy("file_id").collect()] == [("éé", True), ("abc", False), (None, False)]


def test_changed_and_cached_files(spark, tmp_path):
    (tmp_path / "list").write_text("M\ta.py\nD\tb.py\nR100\told.py\t./c//d.py\nA\te.py\n")
    changed = source.name_status(spark, str(tmp_path / "list"))
    files = spark.createDataFrame([(i, p, "python", "x", "2024-01-01 00:00:00") for i, p in enumerate(["a.py", "b.py", "c/d.py", "z.py"])], FILES + ", modified string")
    assert sorted(r["path"] for r in source.changed_only(files, changed).collect()) == ["a.py", "c/d.py"]
    cache = files.select("path", F.sha2(F.when(F.col("path") == "a.py", "x").otherwise("y"), 256).alias("sha256"), F.when(F.col("path") == "b.py", F.col("modified")).otherwise("never").alias("modified"))
    assert sorted(r["path"] for r in source.uncached(files, cache).collect()) == ["c/d.py", "z.py"]


def test_rule_files_and_hooks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"rules": [{"id": "B-1", "pattern": r"de(bug)+", "languages": ["PYTHON"], "severity": "high"}, {"id": "B-2", "pattern": "("}, {"pattern": "x"}, "no rule"]}))
    (tmp_path / "sub/b.json").write_text(json.dumps([{"id": "C-1", "query": r"(?i)todo\((\w+)\)", "severity": "?"}, {"id": "C-2", "pattern": "a", "enabled": False}]))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.txt").write_text("[]")
    rules = custom.load(spark, str(tmp_path))
    assert [(r.id, r.severity) for r in rules] == [("B-1", "HIGH"), ("C-1", "MEDIUM")]
    df = spark.createDataFrame([(1, "a.py", "python", "x debugbug\n# TODO(me) todo(you)"), (2, "b.go", "go", "debug todo(x)"), (3, "c", "go", None)], FILES)
    got = sorted((r["file_id"], r["rule_id"], r["line"], r["column"], r["match_length"]) for r in custom.findings(df, rules).collect())
    assert got == [(1, "B-1", 1, 3, 8), (1, "C-1", 2, 3, 8), (1, "C-1", 2, 12, 9), (2, "C-1", 1, 7, 7)]

    def broken(rows):
        raise ValueError("no")

    kept = custom.hooked(custom.findings(df, rules), [lambda d: d.where("rule_id = 'C-1'"), broken, lambda d: None])
    assert kept.count() == 3


def test_data_flow():
    def got(text):
        return [(r, line, path) for r, line, _, _, path, _ in taint.flows(text)]

    assert got("a = input()\nb = a\nxs = []\nxs.append(b)\nos.system(xs[0])") == [("TAINT-002", 5, ["source:input", "var:a", "var:b", "append", "[]", "sink:os.system"])]
    assert got("y = f(input())\nopen(y)\ndef f(x):\n    return x\n") == [("TAINT-005", 2, ["source:input", "arg→f", "var:y", "sink:open"])]
    assert got("def f(x):\n    return x\ny = f(input())\nopen(int(y))\nopen(y)") == [("TAINT-005", 5, ["source:input", "call:f", "var:y", "sink:open"])]
    assert got("def f(x):\n    return x\nopen(f(1))") == [("TAINT-005", 3, ["call:f", "sink:open"])]
    assert got("def g():\n    return 1\neval(g())\neval(shlex.quote(input()))\njson.loads(input())") == []
    assert got("d = {'k': [input()]}\nd2, e = (d, 1)\npickle.loads(e)\nw.write(f'{e} {d}')\ndocument.write(d)") == [("TAINT-004", 3, ["source:input", "container", "dict", "var:d", "container", "var:e", "sink:pickle.loads"]), ("TAINT-007", 4, ["source:input", "container", "dict", "var:d", "f-string", "sink:w.write"])]
    assert got("q = input()\neval(q); eval(q)") == [("TAINT-001", 2, ["source:input", "var:q", "sink:eval"])]
    assert got("def f(:") == got("") == got(None) == got("x\0") == []
    assert len(got("x = input()\ny = " + "f(" * 60 + "x" + ")" * 60 + "\neval(y)")) == 1


def test_history_audit_and_documents(spark, tmp_path):
    runs = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 00:00:00", i % 2, 10 * i) for i in range(6)], "run_id long, ts string, tenant_id long, risk_score long").withColumn("ts", F.to_timestamp("ts"))
    at = str(tmp_path / "history")
    sinks.append_history(runs.where("run_id < 3"), at)
    sinks.append_history(runs.where("run_id >= 3"), at)
    assert [r["run_id"] for r in sinks.recent_runs(spark, at, 3).collect()] == [5, 2, 4]
    assert [r["run_id"] for r in sinks.recent_runs(spark, at, 2, tenant_id=1).collect()] == [5, 1]
    args = spark.createDataFrame([({"source_code": "abc", "path": "p" * 200, "x": "short", "y": "l" * 130, "token": None},)], "a map<string,string>")
    assert args.select(sinks.safe_arguments(F.col("a"))).first()[0] == {"source_code": "<redacted len=3>", "path": "p" * 200, "x": "short", "y": "str", "token": "<redacted>"}
    log = str(tmp_path / "audit")
    events = spark.createDataFrame([(i, i, i % 3, "scan" if i % 2 else "other") for i in range(600)], "event_id long, ts long, tenant_id long, tool string")
    sinks.append_audit(events, log)
    recent = sinks.recent_audit(spark.read.json(log), 5, 0, "scan").collect()
    assert [r["event_id"] for r in recent] == [597, 591, 585, 579, 573]
    assert sinks.recent_audit(spark.read.json(log), 900).count() == 500
    found = spark.createDataFrame([(1, "B", "HIGH", "a\\b.py", 3, 1, "", "Two"), (1, "A", "odd", "a\\b.py", 1, 0, "x**", "One"), (1, "B", "LOW", "a\\b.py", 9, 2, "", "Two")], "file_id long, rule_id string, severity string, path string, line int, column int, excerpt string, title string")
    sinks.write_documents(sinks.sarif(found, ["file_id"]), str(tmp_path / "sarif"))
    run = json.loads(spark.read.text(str(tmp_path / "sarif")).first()[0])["runs"][0]
    assert [(r["id"], r["defaultConfiguration"]["level"], r["properties"]["security-severity"]) for r in run["tool"]["driver"]["rules"]] == [("A", "warning", "5.0"), ("B", "error", "7.0")]
    assert [(r["ruleId"], r["ruleIndex"], r["message"]["text"]) for r in run["results"]] == [("A", 0, "One | excerpt: x**"), ("B", 1, "Two"), ("B", 1, "Two")]
    region = run["results"][0]["locations"][0]["physicalLocation"]
    assert region["artifactLocation"]["uri"] == "a/b.py" and region["region"] == {"startLine": 1, "startColumn": 1, "snippet": {"text": "x**"}}
    assert sinks.html_rows(found.select("rule_id", F.lit("<&>").alias("t")).limit(1)).first()[0] == "<tr><td>B</td><td>&lt;&amp;&gt;</td></tr>"
    lines = sinks.metrics_text(spark.createDataFrame([('a"b', 3, None)], "tool string, calls long, denied long")).collect()
    assert [r[0] for r in lines] == ['sieveline_calls{tool="a\\"b"} 3', 'sieveline_denied{tool="a\\"b"} NaN']
