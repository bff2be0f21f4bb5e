"""Data flow through whole projects: which outside values reach which sinks over assignments, calls and returns, across files.

Each file is parsed once, by a task, into rows: edges from name to name, names that outside values enter, parameters, arguments of calls whose function is
known by the file's own definitions or its imports, and sinks. Arguments meet parameters of other files in a join; the closure over all edges is a series of
joins, each from the names that the last one reached, or reached by a shorter path. Flow does not depend on the order of statements, as paths may leave a file and
come back; taint.py, which walks one file in order, may find less.
"""

from __future__ import annotations

import ast
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.taint import RULES, Way, dotted, facts, ways
from sieveline.sources.shared import saved, ship

_FIELDS = {
    "kind": pa.string(), "src": pa.string(), "dst": pa.string(), "fn": pa.string(), "slot": pa.string(), "steps": pa.list_(pa.string()), "rule_id": pa.string(), "line": pa.int32(), "column": pa.int32(), "sink": pa.string(), "excerpt": pa.string(),
}
#: Rows that go from a task's Python to Spark at once, but for those of the last file.
MOST_ROWS = 4096
_SCHEMA = "kind string, src string, dst string, fn string, slot string, steps array<string>, rule_id string, line int, column int, sink string, excerpt string"


def module_of(path: str) -> str:
    """a/b.py as a.b, a/__init__.py as a."""
    parts = path.removesuffix(".py").removesuffix(".pyw").strip("/").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def _imports(tree: ast.Module, module: str, package: bool) -> dict[str, tuple[str, str]]:
    """Local name to (module, name there); the name is '' for a module."""
    out = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out |= {a.asname or a.name: (a.name, "") for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            base = module.split(".") if module else []
            base = base[: len(base) - n.level + package] if n.level else []
            root = ".".join([*base, *([n.module] if n.module else [])])
            out |= {a.asname or a.name: (root, a.name) for a in n.names}
    return out


def rows_of(source: str, module: str, package: bool = False) -> list[dict]:
    """The rows of one file. Nodes are 'module:v:name' for a variable or parameter and 'module:r:function' for what a function returns."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(source)
            found = facts(source, tree)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
    own = {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    imported = _imports(tree, module, package)

    def function(q: str) -> str:
        """'module:function' of a callee, '' where it is not known."""
        if q in own:
            return f"{module}:{q}"
        if q in imported and imported[q][1]:
            return ":".join(imported[q])
        root, _, last = q.rpartition(".")
        return f"{imported[root][0]}:{last}" if root in imported and not imported[root][1] else (f"{'.'.join(imported[root])}:{last}" if root in imported else "")

    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call)]
    returned = {}
    for n in calls:
        q = dotted(n.func)
        if to := function(q):
            returned.setdefault(q.rpartition(".")[2], to)
    out: list[dict] = []

    def flow(some: list[Way], kind: str, steps=(), **more) -> None:
        for w in some:
            said = [x if isinstance(x, str) else x[2] for x in w.steps]
            if not w.outside:
                out.append({"kind": kind, "src": f"{module}:v:{w.name}", "steps": [*said, *steps], **more})
            elif not w.needs:
                out.append({"kind": kind, "steps": [w.name, *said, *steps], **more})
            elif w.needs in returned:
                where, _, name = returned[w.needs].rpartition(":")
                out.append({"kind": kind, "src": f"{where}:r:{name}", "steps": [f"return:{name}", *said, *steps], **more})

    for kind, *fact in found:
        if kind == "params":
            out += [{"kind": "param", "fn": f"{module}:{fact[0]}", "slot": slot, "dst": f"{module}:v:{name}"} for i, name in enumerate(fact[1]) for slot in (str(i), name)]
        elif kind == "assign":
            for name, step in fact[0]:
                flow(fact[1], "edge", (step,), dst=f"{module}:v:{name}")
        elif kind == "returns":
            for some in fact[1]:
                flow(some, "edge", dst=f"{module}:r:{fact[0]}")
        else:
            rule, q, line, column, some, text = fact
            flow(some, "sink", (f"sink:{q}",), rule_id=rule, line=line, column=column, sink=q, excerpt=text)
    for n in calls:
        if to := function(dotted(n.func)):
            name = to.rpartition(":")[2]
            for slot, value in [*((str(i), a) for i, a in enumerate(n.args)), *((k.arg, k.value) for k in n.keywords if k.arg)]:
                flow(ways(value), "argument", (f"into:{name}",), fn=to, slot=slot)
    return out


def parsed(files: DataFrame) -> DataFrame:
    """project, file_id, path and the rows of all Python files of files(project, file_id, path within the project, language, content); null content is empty."""
    ship(files.sparkSession)

    def batch_of(source, at, rows):
        some = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([source.column(c).take(some) for c in range(3)] + [pa.array([r.get(k) for r in rows], kind) for k, kind in _FIELDS.items()], names=["project", "file_id", "path", *_FIELDS])

    def each(batches):
        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                path = batch.column(2)[i].as_py() or ""
                own = rows_of(batch.column(3)[i].as_py() or "", module_of(path), path.endswith("__init__.py"))
                at += [i] * len(own)
                rows += own
                if len(rows) >= MOST_ROWS:
                    yield batch_of(batch, at, rows)
                    at, rows = [], []
            yield batch_of(batch, at, rows)

    python = files.where("language = 'python'").select(F.coalesce(F.col("project").cast("string"), F.lit("")).alias("project"), F.col("file_id").cast("long").alias("file_id"), "path", "content")
    return python.mapInArrow(each, f"project string, file_id long, path string, {_SCHEMA}")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """project, node, way: every node that seeds(project, dst, steps) reach over edges(project, src, dst, steps), with its shortest path (the least of equal ones).

    Each round joins the edges with the nodes that the last round reached, or reached by a better path, only; it ends when there are none. The number of rounds
    is that of the edges of the longest of the shortest paths. Rounds are written, so a lost executor costs one of them.
    """
    better = lambda df: df.groupBy("project", "node").agg(F.min(F.struct(F.size("way").alias("n"), F.col("way").alias("way"))).alias("best")).select("project", "node", F.col("best.way").alias("way"))
    known = fresh = saved(better(seeds.select("project", F.col("dst").alias("node"), F.col("steps").alias("way"))), "reached")
    while fresh.limit(1).count():
        step = fresh.select("project", F.col("node").alias("src"), "way").join(edges, ["project", "src"]).select("project", F.col("dst").alias("node"), F.concat("way", "steps").alias("way"))
        old = known.select("project", "node", F.col("way").alias("_way"))
        shorter = F.col("_way").isNull() | (F.struct(F.size("way"), F.col("way")) < F.struct(F.size("_way"), F.col("_way")))
        fresh = saved(better(step).join(old, ["project", "node"], "left").where(shorter).drop("_way"), "fresh")
        known = saved(known.join(fresh, ["project", "node"], "left_anti").unionByName(fresh), "reached")
    return known


def findings(files: DataFrame, parameters: bool = False) -> DataFrame:
    """project, file_id, path, rule_id, severity, line, column, sink, source, hops, way, excerpt: the sinks that outside values reach, each by its shortest path.

    hops is how often the path enters a function; way is the path, from the source to the sink. parameters: all parameters count as outside values, as
    in taint.py. Of the same rules, lines and sinks of a file one is kept. Null, empty and broken files have none.
    """
    rows = saved(parsed(files), "flow")
    known = rows.where("kind = 'param'").select("project", "fn", "slot", "dst")
    passed = rows.where("kind = 'argument'").drop("dst").join(known.dropDuplicates(["project", "fn", "slot"]), ["project", "fn", "slot"])
    moves = saved(rows.where("kind = 'edge'").select("project", "src", "dst", "steps").unionByName(passed.select("project", "src", "dst", "steps")), "edges")
    seeds = moves.where("src IS NULL").drop("src")
    if parameters:
        seeds = seeds.unionByName(known.select("project", "dst", F.array(F.concat(F.lit("param:"), F.split_part("fn", F.lit(":"), F.lit(-1)), F.lit("."), F.split_part("dst", F.lit(":"), F.lit(-1)))).alias("steps")))
    reached = closure(moves.where("src IS NOT NULL"), seeds)
    sinks = rows.where("kind = 'sink'")
    there = sinks.where("src IS NOT NULL").join(reached.select("project", F.col("node").alias("src"), "way"), ["project", "src"]).withColumn("way", F.concat("way", "steps"))
    all_ = there.unionByName(sinks.where("src IS NULL").withColumn("way", F.col("steps")))
    keys = ["project", "file_id", "path", "rule_id", "line", "sink"]
    best = all_.groupBy(*keys).agg(F.min(F.struct(F.size("way").alias("n"), F.col("way").alias("way"), F.col("column").alias("column"), F.col("excerpt").alias("excerpt"))).alias("b"))
    severity = F.coalesce(*(F.when(F.col("rule_id") == k, v[0]) for k, v in RULES.items()))
    hops = F.size(F.filter("b.way", lambda x: F.startswith(x, F.lit("into:")))).cast("long")
    return best.select("project", "file_id", "path", "rule_id", severity.alias("severity"), "line", "b.column", "sink", F.get("b.way", F.lit(0)).alias("source"), hops.alias("hops"), "b.way", "b.excerpt")
