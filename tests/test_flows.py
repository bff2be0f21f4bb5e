"""Flow between files, tree queries, diffs, incremental scans and rate limits on streams: odd rows, and each against a plain reading."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import catalog, control, reach, taint, trees
from sieveline.sources import diffs
from sieveline.sources.shared import shared_path, ship
from sieveline.streaming import gateway, increments, live

FILES = "project string, file_id long, path string, language string, content string"


def project(spark, *contents, parameters=False):
    rows = [("p", i, path, "python", text) for i, (path, text) in enumerate(contents)]
    return {(r["path"], r["rule_id"], r["line"]): r for r in reach.findings(spark.createDataFrame(rows, FILES), parameters).collect()}


def test_a_flow_over_three_files(spark):
    web = "from flask import request\nfrom pkg.mid import passed as on\nimport pkg.util as u\n\ndef view():\n    q = request.args.get('q')\n    on(other=1, value=q)\n    open(u.made())\n    eval(int(q))\n"
    mid = "from .util import launch, made\nimport pkg.util\n\ndef passed(other, value):\n    text = f'x {value}'\n    launch(text)\n    pkg.util.safe(value)\n    launch2(value)\n"
    util = "import os\n\ndef launch(cmd):\n    os.system(cmd)\n\ndef made():\n    return input()\n\ndef safe(x):\n    eval(escape(x))\n"
    got = project(spark, ("web.py", web), ("pkg/mid.py", mid), ("pkg/util.py", util), ("pkg/__init__.py", None), ("broken.py", "def ("), ("other.py", "def launch(cmd):\n    eval(cmd)\n"))
    assert set(got) == {("pkg/util.py", "TAINT-002", 4), ("web.py", "TAINT-005", 8)}
    r = got["pkg/util.py", "TAINT-002", 4]
    assert r["source"] == "source:request.args.get" and r["hops"] == 2 and r["way"] == ["source:request.args.get", "var:q", "into:passed", "f-string", "var:text", "into:launch", "sink:os.system"]
    assert got["web.py", "TAINT-005", 8]["way"] == ["source:input", "return:made", "sink:open"]


def test_projects_and_loops_stay_apart(spark):
    a, b = "from b import f\ndef g(x):\n    f(x)\n    eval(x)\ng(input())\n", "from a import g\ndef f(y):\n    g(y)\n"
    rows = [(p, i, path, lang, text) for i, (p, path, lang, text) in enumerate([("one", "a.py", "python", a), ("one", "b.py", "python", b), ("two", "a.py", "python", a.replace("g(input())", "")), ("two", "b.py", "python", b), (None, "c.py", "python", ""), ("two", "d.py", "go", "g(input())")])]
    got = [(r["project"], r["path"], r["line"], r["hops"]) for r in reach.findings(spark.createDataFrame(rows, FILES)).collect()]
    assert got == [("one", "a.py", 4, 1)]
    assert reach.findings(spark.createDataFrame([], FILES)).count() == 0


def test_single_files_agree_with_the_walk_in_order(spark):
    texts = [
        "import sys\nx = sys.argv[1]\ny = [x]\nz = {'k': y}\nopen(z)\neval(int(x))\n",
        "def f(a):\n    b = a\n    return b\nc = f(input())\nos.system(c)\nq = 'x'\neval(q)\n",
        "import pickle\nfrom flask import request\nd = []\nd.append(request.form)\npickle.loads(d)\nfile.write(d)\nrequests.get(url=d)\n",
        "def h(p):\n    cur.execute('a' + p)\n",
    ]
    for text in texts:
        want = {(r[0], r[1], r[3]) for r in taint.flows(text)}
        got = {(r["rule_id"], r["line"], r["sink"]) for r in project(spark, ("m.py", text), parameters=True).values()}
        assert want and got == want


def found(spark, text, *rules, path="a.py", language="python"):
    df = spark.createDataFrame([(1, path, language, text)], "file_id long, path string, language string, content string")
    return sorted((r["rule_id"], r["line"], r["column"], r["excerpt"]) for r in trees.findings(df, rules or trees.RULES).collect())


def test_trees_as_intervals():
    text = "class A:\n    def f(self, x):\n        if x:\n            return [g(y) for y in x]\n\ndef h(): pass\n"
    rows = trees.tree_of(text)
    assert [r[0] for r in rows] == list(range(len(rows))) and rows[0][1] == len(rows) - 1
    for r in rows:
        inside = {o[0] for o in rows if r[0] < o[0] <= r[1]}
        below, todo = set(), [r[0]]
        while todo:
            p = todo.pop()
            own = [o[0] for o in rows if o[2] == p]
            below |= set(own)
            todo += own
        assert inside == below


def test_tree_rules(spark):
    assert found(spark, "é = eval(x); a.eval(y)\nexec ('1')\nsub.run(c); run(c)\n") == [("TREE-PY-001", 1, 6, "eval(x)"), ("TREE-PY-001", 2, 1, "exec ('1')"), ("TREE-PY-002", 3, 1, "sub.run(c)")]
    assert found(spark, None) == found(spark, "def (") == found(spark, "") == found(spark, "eval(x)", language="go") == []
    assert [f[1] for f in found(spark, "a = 1\r\neval(x)\reval(y)\n")] == [2, 3]
    own = trees.rules_of([{"id": "A", "kind": "Call", "within": {"kind": "While"}}, {"id": "B", "kind": "FunctionDef", "holds": {"kind": "Name", "text": "secret"}, "severity": "odd"}, {"id": "C", "kind": "With", "lacks": {"kind": "Return"}}, {"kind": "Call"}, {"id": "D"}, {"id": "E", "kind": "Call", "enabled": False}])
    assert [(r.id, r.severity) for r in own] == [("A", "MEDIUM"), ("B", "MEDIUM"), ("C", "MEDIUM")]
    text = "f(1)\nwhile g(2):\n    def k():\n        secret = h(3)\ndef m(): secrets\nwith a:\n    pass\nwith b:\n    def n():\n        return 1\n"
    assert [(f[0], f[1]) for f in found(spark, text, *own)] == [("A", 2), ("A", 4), ("B", 3), ("C", 6)]
    twice = trees.TreeRule("X", "LOW", "Call", (trees.Part("args", "Constant"),))
    assert [f[1] for f in found(spark, "f(1, 2, 3)\nf()\n", twice)] == [1]
    df = spark.createDataFrame([(1, "a.py", "python", "f(1)")], "file_id long, path string, language string, content string")
    assert trees.findings(df, []).count() == 0


DIFF = """diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -1,4 +1,5 @@ def head
 one
-two
+++ b/not-a-file
+three
 four
@@ -10 +11,2 @@
+eleven
 twelve\r
\\ No newline at end of file
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git "a/sp ace.py" "b/sp ace.py"
--- "a/sp ace.py"
+++ "b/sp ace.py"
@@ -0,0 +1,2 @@
+a
+b
diff --git a/old.bin b/new.bin
rename from old.bin
rename to new.bin
"""


def test_diffs(spark):
    df = spark.createDataFrame([(1, DIFF), (2, None), (3, ""), (4, "not a diff\n@@ -1 +1 @@\n+x"), (5, DIFF)], "diff_id long, text string")
    lines = [(r["path"], r["line"], r["op"], r["text"]) for r in diffs.diff_lines(df.where("diff_id < 5")).orderBy("path", "line").collect()]
    assert lines == [("sp ace.py", 1, "+", "a"), ("sp ace.py", 2, "+", "b"), ("x.py", 1, " ", "one"), ("x.py", 2, "+", "++ b/not-a-file"), ("x.py", 3, "+", "three"), ("x.py", 4, " ", "four"), ("x.py", 11, "+", "eleven"), ("x.py", 12, " ", "twelve")]
    ranges = diffs.changed_ranges(df)
    assert sorted(tuple(r) for r in ranges.where("diff_id = 1").collect()) == [(1, "sp ace.py", 1, 2), (1, "x.py", 2, 3), (1, "x.py", 11, 11)]
    found = spark.createDataFrame([("x.py", n) for n in (1, 2, 3, 3, 4, 11)] + [("./sp ace.py", 2), ("y.py", 2)], "path string, line int")
    assert sorted((r["path"], r["line"]) for r in diffs.on_changed_lines(found, ranges).collect()) == [("./sp ace.py", 2), ("x.py", 2), ("x.py", 3), ("x.py", 3), ("x.py", 11)]
    assert sorted(tuple(r) for r in diffs.totals(found, ranges.where("diff_id = 1")).collect()) == [("sp ace.py", 2, 1), ("x.py", 3, 4)]


def batch(spark, *rows):
    return spark.createDataFrame([(p, "python", c, t) for p, c, t in rows], "path string, language string, content string, modified timestamp")


def tables(spark, root):
    cache = sorted((r["path"], r["sha256"], str(r["modified"]), str(r["result"])) for r in increments.entries(spark, root).collect())
    return cache, sorted(tuple(r) for r in increments.statistics(spark, root).collect())


def test_a_batch_that_runs_twice_leaves_the_same_cache(spark, tmp_path, monkeypatch):
    t = datetime.datetime(2024, 1, 1, 12, 0, 0)
    later = t + datetime.timedelta(microseconds=1)
    one = batch(spark, ("a", "eval(x)", t), ("b", None, t), ("c", "ok", t), ("a", "eval(old)", t - datetime.timedelta(1)), ("n", "x", None))
    two = batch(spark, ("a", "eval(x)", t), ("b", "", later), ("c", "exec(y)\neval(y)", t), ("d", "new", t), ("n", "x", None))
    plain, killed = f"{tmp_path}/plain", f"{tmp_path}/killed"
    for root in (plain, killed):
        increments.opened(spark, root)
        increments.scanned(one, 0, catalog.BASE, root)
    increments.scanned(two, 1, catalog.BASE, plain)
    # killed after its cache is written, before its findings and counts are; then it runs again, and once more
    with monkeypatch.context() as m:
        m.setattr(increments, "ENTRY", None)
        with pytest.raises(Exception):
            increments.scanned(two, 1, catalog.BASE, killed)
    for _ in range(2):
        increments.scanned(two, 1, catalog.BASE, killed)
    assert tables(spark, killed) == tables(spark, plain)
    assert tables(spark, plain)[1] == [(0, 4, 0, 4, 0.0), (1, 5, 1, 4, 0.2)]
    found = spark.read.parquet(f"{killed}/findings/batch=1")
    assert sorted((r["path"], r["rule_id"], r["line"]) for r in found.collect()) == [("a", "SEC-003", 1), ("c", "SEC-003", 1), ("c", "SEC-003", 2)]
    to = f"{tmp_path}/compact"
    increments.compacted(spark, plain, to)
    assert tables(spark, to)[0] == tables(spark, plain)[0]
    increments.scanned(two, 0, catalog.BASE, to)
    assert spark.read.parquet(f"{to}/counts/batch=0").first()["hits"] == 4


def test_rate_limits_in_any_order_of_arrival(spark, tmp_path):
    ship(spark)
    rng = random.Random(4)
    begin = datetime.datetime(2024, 1, 1)
    rows = [(i, begin + datetime.timedelta(microseconds=rng.randrange(3 * 86_400_000_000)), rng.randrange(5)) for i in range(300)]
    asked = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")
    want = {r["event_id"]: r["admitted"] for r in control.token_bucket(asked, "user_id", 2, 20).collect()}
    rows.sort(key=lambda r: r[1])
    for lo in range(0, 300, 100):  # three triggers, each in no order
        part = rows[lo : lo + 100]
        rng.shuffle(part)
        spark.createDataFrame(part, asked.schema).withColumn("ts", F.timestamp_micros(control.micros())).coalesce(1).write.mode("append").parquet(f"{tmp_path}/asked")
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/asked")
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", gateway.STORE)
    try:
        got = {r["event_id"]: r["admitted"] for r in live.drained(gateway.limited(stream, ["user_id"], 2, 20), "limited").collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    last = max(r[1] for r in rows)
    assert set(got) == {r[0] for r in rows if r[1] <= last - datetime.timedelta(hours=1)}
    assert all(want[k] == v for k, v in got.items()) and 0 < sum(got.values()) < len(got)


def test_an_arrival_is_written_by_many_tasks_and_read_as_one_batch(spark, monkeypatch):
    from pathlib import Path

    from sieveline.plans import flows

    made = []
    monkeypatch.setattr(flows, "shared_path", lambda s, name: made.append(shared_path(s, name)) or made[-1])
    rows = flows.incremental_stream(spark, "/root/testdata/sf0.001").orderBy("batch").collect()
    assert [(r["batch"], r["entries"]) for r in rows] == [(0, 180), (1, 200)]
    assert len(list(Path(made[0].removeprefix("file://")).glob("files/*.parquet"))) >= 2 * spark.sparkContext.defaultParallelism


def test_a_file_is_parsed_once(monkeypatch):
    import ast

    seen, parse = [], ast.parse
    text = "import os\ndef f(x):\n    os.system(x)\nf(input())\n"
    with monkeypatch.context() as m:
        m.setattr(ast, "parse", lambda source, *more: seen.append(source) or parse(source, *more))
        kinds = [r["kind"] for r in reach.rows_of(text, "m")]
    assert seen == [text] and sorted(kinds) == ["argument", "argument", "param", "param", "sink"]


def test_files_with_many_rows_cross_batches(spark):
    text = "import os\n" + "os.system(input())\n" * 3000
    rows = [("p", i, f"m{i}.py", "python", text if i % 2 else "") for i in range(5)]
    got = reach.parsed(spark.createDataFrame(rows, FILES).coalesce(1)).groupBy("file_id", "path").count().collect()
    assert sorted((r["file_id"], r["path"], r["count"]) for r in got) == [(1, "m1.py", 6000), (3, "m3.py", 6000)]


def test_files_of_a_folder_are_read_by_many_tasks(spark, tmp_path):
    from sieveline.sources.files import scan_folder

    for i in range(40):
        (tmp_path / f"f{i}.py").write_text("x")
    rows = scan_folder(spark, f"file://{tmp_path}")
    assert rows.count() == 40 and rows.select(F.spark_partition_id()).distinct().count() > 1
