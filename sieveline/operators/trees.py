"""Tree queries: syntax trees as rows with the interval that each node covers, patterns as joins of these rows.

A node's place in a walk of its tree is pre, and last is the place of the last node inside it; so a node holds another one of its file if that one's pre lies between its own
pre and its last. Rules are rows too: what kind of node, what its parts are, what it stands in, what it holds.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.catalog import WEIGHTS
from sieveline.sources.shared import saved, ship

_KINDS = {"pre": pa.int32(), "last": pa.int32(), "parent": pa.int32(), "slot": pa.string(), "kind": pa.string(), "text": pa.string(), "line": pa.int32(), "column": pa.int32(), "start": pa.int64(), "stop": pa.int64(), "excerpt": pa.string()}
MOST_EXCERPT = 160


@dataclass(frozen=True)
class Part:
    """A node that another one must have: as its child in a slot (func, attr, args..), around it, or somewhere in it. text is a pattern for all of its text."""

    slot: str = ""
    kind: str = ""
    text: str = ""


@dataclass(frozen=True)
class TreeRule:
    """A finding for every node of a kind with all its parts, in a node within (where given), with a node holds inside (where given), and with none that lacks names."""

    id: str
    severity: str
    kind: str
    parts: tuple[Part, ...] = ()
    within: Part | None = None
    holds: Part | None = None
    lacks: Part | None = None
    text: str = ""
    title: str = field(default="", compare=False)


#: Callables that run text, and methods that start processes.
RULES = (
    TreeRule("TREE-PY-001", "CRITICAL", "Call", (Part("func", "Name", "eval|exec"),), title="Dynamic evaluation"),
    TreeRule("TREE-PY-002", "HIGH", "Call", (Part("func", "Attribute", "system|popen|Popen|run|call|check_output"),), title="Process start"),
)


def rules_of(rows: Iterable[Mapping]) -> list[TreeRule]:
    """Rules of one's own from mappings, as JSON holds them; those without id or kind, off, or of an unknown severity's name are left out or MEDIUM."""
    part = lambda p: Part(str(p.get("slot", "")), str(p.get("kind", "")), str(p.get("text", ""))) if p else None
    out = []
    for r in rows:
        if r.get("id") and r.get("kind") and r.get("enabled", True):
            severity = str(r.get("severity", "MEDIUM")).upper()
            out.append(TreeRule(str(r["id"]), severity if severity in WEIGHTS else "MEDIUM", str(r["kind"]), tuple(part(p) for p in r.get("parts", ())), part(r.get("within")), part(r.get("holds")), part(r.get("lacks")), str(r.get("text", "")), str(r.get("name", ""))))
    return out


def loaded(text: str) -> list[TreeRule]:
    """rules_of() of a JSON list."""
    return rules_of(json.loads(text))


def _text(n: ast.AST) -> str | None:
    match n:
        case ast.Name():
            return n.id
        case ast.Attribute():
            return n.attr
        case ast.Constant():
            return str(n.value)[:MOST_EXCERPT]
        case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
            return n.name
        case ast.arg() | ast.keyword():
            return n.arg
        case ast.alias():
            return n.name
    return None


def tree_of(content: str) -> list[tuple]:
    """The nodes of a Python file, in the order of a walk from the root; none for text that is not Python. Columns and places count bytes, those of a line
    end as one."""
    content = content.replace("\r\n", "\n").replace("\r", "\n")
    try:
        root = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = content.encode().split(b"\n")
    before, at = [], 0
    for line in lines:
        before.append(at)
        at += len(line) + 1
    out: list[list] = []
    todo: list[tuple] = [(root, -1, "")]
    while todo:
        n, parent, slot = todo.pop()
        if n is None:  # all of the parent's nodes are out
            out[parent][1] = len(out) - 1
            continue
        pre = len(out)
        if hasattr(n, "lineno"):
            start, stop = before[n.lineno - 1] + n.col_offset, before[n.end_lineno - 1] + n.end_col_offset
            shown = (lines[n.lineno - 1][n.col_offset :] if n.end_lineno > n.lineno else lines[n.lineno - 1][n.col_offset : n.end_col_offset]).decode(errors="replace").strip()[:MOST_EXCERPT]
            place = (n.lineno, n.col_offset + 1, start, stop, shown)
        else:
            place = (None,) * 5
        out.append([pre, pre, parent if parent >= 0 else None, slot, type(n).__name__, _text(n), *place])
        todo.append((None, pre, ""))
        inner = [(c, pre, name) for name, value in ast.iter_fields(n) for c in (value if isinstance(value, list) else [value]) if isinstance(c, ast.AST) and not isinstance(c, ast.expr_context)]
        todo += reversed(inner)
    return [tuple(x) for x in out]


def nodes(files: DataFrame) -> DataFrame:
    """file_id, path, pre, last, parent, slot, kind, text, line, column, start, stop, excerpt: all nodes of all Python files; a file is parsed in one task."""
    ship(files.sparkSession)

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = tree_of(batch.column(2)[i].as_py() or "")
                at = pa.array([i] * len(rows), pa.int64())
                columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, k) for c, k in zip(columns, _KINDS.values(), strict=True))], names=["file_id", "path", *_KINDS])

    python = files.where("language = 'python'").select(F.col("file_id").cast("long").alias("file_id"), "path", "content")
    return python.mapInArrow(each, "file_id long, path string, pre int, last int, parent int, slot string, kind string, text string, line int, column int, start long, stop long, excerpt string")


def _fits(p: Part | TreeRule):
    ok = F.lit(True)
    if p.kind:
        ok = ok & (F.col("kind") == p.kind)
    if p.text:
        ok = ok & F.coalesce(F.col("text").rlike(f"^(?:{p.text})$"), F.lit(False))
    return ok


def matches(tree: DataFrame, rule: TreeRule) -> DataFrame:
    """The nodes of tree, a saved table of nodes(), that a rule finds. Each condition is a semi-join: by parent, or by containment in the same file."""
    found = tree.where(_fits(rule))
    for p in rule.parts:
        child = tree.where(_fits(p))
        if p.slot:
            child = child.where(F.col("slot") == p.slot)
        found = found.join(child.select("file_id", F.col("parent").alias("pre")).distinct(), ["file_id", "pre"], "left_semi")
    inner = lambda p: tree.where(_fits(p) & (F.lit(not p.slot) | (F.col("slot") == p.slot))).select(F.col("file_id").alias("_file"), F.col("pre").alias("_pre"), F.col("last").alias("_last"))
    if rule.within:
        found = found.join(inner(rule.within), (F.col("file_id") == F.col("_file")) & (F.col("_pre") < F.col("pre")) & (F.col("pre") <= F.col("_last")), "left_semi")
    for p, how in ((rule.holds, "left_semi"), (rule.lacks, "left_anti")):
        if p:
            found = found.join(inner(p), (F.col("file_id") == F.col("_file")) & (F.col("_pre") > F.col("pre")) & (F.col("_pre") <= F.col("last")), how)
    return found


def findings(files: DataFrame, rules: Iterable[TreeRule] = RULES) -> DataFrame:
    """file_id, path, engine, ord, rule_id, severity, line, column (bytes), start, stop, excerpt: what the rules find, each place once for a rule."""
    tree = saved(nodes(files), "trees")
    out = None
    for i, r in enumerate(rules):
        one = matches(tree, r).select("file_id", "path", F.lit("tree").alias("engine"), F.lit(i).alias("ord"), F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), "line", "column", "start", "stop", "excerpt")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = matches(tree, TreeRule("", "", "")).where("false").select("file_id", "path", F.lit("tree").alias("engine"), F.lit(0).alias("ord"), F.lit("").alias("rule_id"), F.lit("").alias("severity"), "line", "column", "start", "stop", "excerpt")
    return out.dropDuplicates(["file_id", "start", "stop", "rule_id"])
