"""Findings from Python syntax trees: parsing gives an ordered array of facts per file, folds and a rule table in Spark do the rest."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.sources.shared import ship

FACT = "kind string, qualifier string, name string, module string, targets array<string>, reads array<string>, source boolean, shape string, shell boolean, safe boolean, mode string, line int, column int, excerpt string"
#: Callables and attributes whose values are untrusted.
SOURCE_CALLS = {"input", "raw_input", "getline"}
REQUEST_PARTS = {"args", "form", "values", "json", "data", "cookies", "headers", "get_json", "get"}
SOURCE_ATTRIBUTES = {("request", p) for p in REQUEST_PARTS} | {("sys", "argv"), ("os", "environ")}
SPAWN = ["run", "Popen", "call", "check_output", "check_call"]
RUN_SQL = ["execute", "executemany", "executescript"]
RISKY_MODULES = ["pickle", "marshal", "shelve"]
EXCERPT = 140


def _dotted(node: ast.AST) -> tuple[str | None, str | None]:
    """(qualifier, last name) of a name or attribute; the qualifier only where it is a plain name."""
    if isinstance(node, ast.Attribute):
        return (node.value.id if isinstance(node.value, ast.Name) else None), node.attr
    return None, getattr(node, "id", None)


def _is_source(node: ast.AST) -> bool:
    if isinstance(node, ast.Call):
        qualifier, name = _dotted(node.func)
        return (isinstance(node.func, ast.Name) and name in SOURCE_CALLS) or (qualifier, name) in SOURCE_ATTRIBUTES or (isinstance(node.func, ast.Attribute) and _is_source(node.func.value))
    if isinstance(node, ast.Subscript):
        return _is_source(node.value)
    return isinstance(node, ast.Attribute) and (_dotted(node) in SOURCE_ATTRIBUTES or _dotted(node.value)[0] == "request")


def flows(node: ast.AST | None) -> tuple[list[str], bool]:
    """Names whose values reach an expression's value, and whether an untrusted source does."""
    names, source, todo = set(), False, [node]
    while todo:
        n = todo.pop()
        source |= _is_source(n)
        match n:
            case ast.Name():
                names.add(n.id)
            case ast.JoinedStr():
                todo += [v.value for v in n.values if isinstance(v, ast.FormattedValue)]
            case ast.BinOp():
                todo += [n.left, n.right]
            case ast.Call():
                todo += [*n.args, *(k.value for k in n.keywords)]
            case ast.Attribute():
                todo.append(n.value)
            case ast.Subscript():
                todo += [n.value, n.slice]
    return sorted(names), source


def _names(targets: list[ast.AST]) -> list[str]:
    flat = [e for t in targets for e in (t.elts if isinstance(t, ast.Tuple) else [t])]
    return [t.id for t in flat if isinstance(t, ast.Name)]


def facts(content: str) -> list[dict]:
    """Imports, assignments and calls of a file, in the order of its text; one fact of kind error for text that is not Python."""
    try:
        tree = ast.parse(content)
    except SyntaxError as e:
        return [{"kind": "error", "line": e.lineno or 1, "column": e.offset or 1}]
    except (ValueError, RecursionError, MemoryError):
        return [{"kind": "unparsed", "line": 1, "column": 1}]
    lines = [x.encode() for x in content.split("\n")]
    out, modules, todo = [], {}, [tree]

    def fact(node: ast.AST, kind: str, **more) -> None:
        cut = lines[node.lineno - 1 : node.end_lineno]
        cut[-1] = cut[-1][: node.end_col_offset]
        cut[0] = cut[0][node.col_offset :]
        out.append({"kind": kind, "line": node.lineno, "column": node.col_offset + 1, "excerpt": b" ".join(cut).decode(errors="replace")[:EXCERPT], **more})

    while todo:
        n = todo.pop()
        match n:
            case ast.Import():
                for a in n.names:
                    modules[a.asname or a.name] = a.name.split(".")[0]
                    fact(n, "import", module=a.name.split(".")[0], name=a.name)
            case ast.ImportFrom():
                root = (n.module or "").split(".")[0]
                for a in n.names:
                    modules |= {a.asname or a.name: root} if root else {}
                    fact(n, "import", module=root, name=a.name, targets=[a.asname or a.name])
            case ast.Assign() | ast.AnnAssign() | ast.AugAssign() if n.value is not None:
                reads, source = flows(n.value)
                bound = n.value.id if isinstance(n.value, ast.Name) and isinstance(n, ast.Assign) else None
                fact(n, "assign", targets=_names(n.targets if isinstance(n, ast.Assign) else [n.target]), reads=reads, source=source, name=bound)
            case ast.Call():
                qualifier, name = _dotted(n.func)
                first = n.args[0] if n.args else None
                reads, source = flows(first)
                words = {k.arg: k.value for k in n.keywords}
                shape = "formatted" if isinstance(first, ast.Call) and _dotted(first.func)[1] == "format" and isinstance(first.func, ast.Attribute) else type(first).__name__
                mode = n.args[1].value if len(n.args) > 1 and isinstance(n.args[1], ast.Constant) and isinstance(n.args[1].value, str) else None
                loader = words.get("Loader")
                fact(n, "call" if isinstance(n.func, ast.Name) else "method", qualifier=qualifier, name=name, module=modules.get(qualifier or "", qualifier), reads=reads, source=source, shape=shape, shell=isinstance(words.get("shell"), ast.Constant) and words["shell"].value is True, safe=isinstance(loader, ast.Attribute) and loader.attr in ("SafeLoader", "CSafeLoader"), mode=mode)
        todo += reversed(list(ast.iter_child_nodes(n)))
    return out


def python_facts(files: DataFrame) -> DataFrame:
    """file_id, path, has_code, facts of the Python files: one row each, so a file is the unit of work. Null content is an empty file."""
    ship(files.sparkSession)
    fields = [x.strip().split(" ") for x in FACT.split(", ")]
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_(), "int": pa.int32()}
    kind = pa.list_(pa.struct([(name, kinds[k]) for name, k in fields]))

    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([facts(t.as_py() or "") for t in batch.column(2)], kind), batch.column(3)], names=["file_id", "path", "facts", "has_code"])

    rows = files.where("language = 'python'").select(F.col("file_id").cast("long").alias("file_id"), "path", "content", F.col("content").rlike(r"\b(?:def|class|import)\b").alias("has_code"))
    declared = ", ".join(f"{name}: {k}" for name, k in fields)
    return rows.mapInArrow(each, f"file_id long, path string, facts array<struct<{declared}>>, has_code boolean")


def _marked(parsed: DataFrame) -> DataFrame:
    """Facts as rows with dirty (an untrusted value reaches it) and aliased (a call through a name bound to eval or exec).

    One fold per file in the order of its text: assignments of untrusted values taint their targets for what follows; the file has one scope.
    """
    strings, ints = F.array().cast("array<string>"), F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), strings.alias("tainted"), strings.alias("aliases"), ints.alias("dirty"), ints.alias("aliased"))

    def step(acc: Column, f: Column) -> Column:
        dirty = F.coalesce(f["source"] | F.arrays_overlap(f["reads"], acc["tainted"]), F.lit(False))
        binds = F.coalesce(f["kind"].isin("assign", "import") & f["name"].isin("eval", "exec"), F.lit(False))
        through = F.coalesce((f["kind"] == "call") & F.array_contains(acc["aliases"], f["name"]), F.lit(False))
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(dirty & (f["kind"] == "assign"), F.array_union(acc["tainted"], f["targets"])).otherwise(acc["tainted"]).alias("tainted"),
            F.when(binds & f["targets"].isNotNull(), F.array_union(acc["aliases"], f["targets"])).otherwise(acc["aliases"]).alias("aliases"),
            F.when(dirty, F.concat(acc["dirty"], F.array(acc["at"]))).otherwise(acc["dirty"]).alias("dirty"),
            F.when(through, F.concat(acc["aliased"], F.array(acc["at"]))).otherwise(acc["aliased"]).alias("aliased"),
        )

    walked = parsed.withColumn("w", F.aggregate("facts", start, step))
    rows = walked.select("file_id", "path", "has_code", "w", F.posexplode("facts").alias("at", "f"))
    return rows.select("file_id", "path", "has_code", "at", "f.*", F.array_contains("w.dirty", F.col("at")).alias("dirty"), F.array_contains("w.aliased", F.col("at")).alias("aliased"))


def _rules() -> list[tuple[str, str, Column]]:
    """(rule, severity, condition on a fact), in the order in which findings of one place are listed."""
    c = F.col
    called = c("kind").isin("call", "method")
    loads = c("name").isin("load", "loads", "Unpickler")
    woven = c("shape").isin("JoinedStr", "BinOp", "formatted")
    return [
        ("AST-000", "LOW", (c("kind") == "error") & c("has_code")),
        ("AST-010", "MEDIUM", (c("kind") == "import") & c("module").isin(*RISKY_MODULES)),
        ("AST-003", "CRITICAL", c("aliased")),
        ("AST-003", "CRITICAL", called & c("name").isin("eval", "exec") & (c("qualifier").isNull() | (c("qualifier") == "builtins"))),
        ("AST-003b", "HIGH", called & (c("name") == "compile") & c("mode").isin("exec", "eval", "single")),
        ("AST-005", "HIGH", called & c("name").isin("system", "popen") & (c("qualifier").isNull() | (c("qualifier") == "os") | (c("module") == "os"))),
        ("AST-005", "HIGH", called & c("name").isin(*SPAWN) & c("shell")),
        ("AST-005t", "CRITICAL", called & c("name").isin(*SPAWN) & c("dirty") & (c("shape").isin("Name", "JoinedStr", "BinOp") | c("shell"))),
        ("AST-004", "CRITICAL", called & c("name").isin(*RUN_SQL) & c("dirty")),
        ("AST-004b", "HIGH", called & c("name").isin(*RUN_SQL) & ~c("dirty") & woven),
        ("AST-009", "HIGH", called & loads & (c("module").isin("pickle", "marshal", "_pickle") | c("qualifier").isin("pickle", "marshal", "_pickle"))),
        ("AST-006", "HIGH", called & (c("name") == "load") & ((c("qualifier") == "yaml") | (c("module") == "yaml")) & ~c("safe")),
        ("AST-011", "MEDIUM", called & (c("name") == "open") & c("dirty")),
    ]


def findings(files: DataFrame) -> DataFrame:
    """file_id, path, engine, ord, rule_id, severity, line, column, match_length, excerpt of the syntax-tree rules, as the grids give them.

    ord numbers a file's findings by place in the text, then by rule. Files that do not parse have one AST-000 finding if they look
    like code, else none. match_length is 0. No shuffle.
    """
    rules = _rules()
    hits = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(i).alias("i"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"))) for i, (rule, severity, cond) in enumerate(rules))))
    rows = _marked(python_facts(files)).select("file_id", "path", "at", "line", "column", "excerpt", F.explode(hits).alias("h"))
    return rows.select("file_id", "path", F.lit("syntax").alias("engine"), (F.col("at") * len(rules) + F.col("h.i")).alias("ord"), "h.rule_id", "h.severity", "line", "column", F.lit(0).alias("match_length"), F.coalesce("excerpt", F.lit("")).alias("excerpt"))
