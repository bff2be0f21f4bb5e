"""Rules of one's own from JSON or YAML files, and hooks around a scan."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import scan
from sieveline.operators.catalog import WEIGHTS, Rule

PATTERNS = ("regex", "regexp", "pattern")


def parsed(name: str, text: str) -> list[dict]:
    """The rules of one file: a list, or an object with rules or custom_rules. A file that does not parse has none; YAML needs a YAML module."""
    try:
        if name.lower().endswith((".yaml", ".yml")):
            import yaml

            data = yaml.safe_load(text)
        else:
            data = json.loads(text)
    except ImportError:
        logging.getLogger(__name__).warning("no YAML module: %s is left out", name)
        return []
    except Exception as e:  # noqa: BLE001 - a broken file of a user leaves out its own rules only
        logging.getLogger(__name__).warning("%s is left out: %s", name, e)
        return []
    if isinstance(data, dict):
        data = data.get("rules") or data.get("custom_rules") or []
    return [r for r in data or [] if isinstance(r, dict)]


def valid(spark: SparkSession, pattern: str) -> bool:
    """Whether Spark takes the pattern. It is tried on a literal, which the optimiser computes on the driver."""
    try:
        return spark.range(1).select(F.lit("").rlike(f"(?m){pattern}")).first() is not None
    except (PySparkException, Py4JError):
        return False


def rules_of(spark: SparkSession, raw: Iterable[dict]) -> tuple[Rule, ...]:
    """Rules for scan.grid() from mappings with id, pattern, languages, severity, type, enabled, name: those without an id or a pattern, that are off, of another type or with a broken pattern are left out."""
    out = []
    for r in raw:
        name, pattern = str(r.get("id") or "").strip(), str(r.get("pattern") or r.get("query") or "")
        severity = str(r.get("severity") or "MEDIUM").upper()
        if name and pattern and r.get("enabled", True) and str(r.get("type") or "regex").lower() in PATTERNS and valid(spark, pattern):
            out.append(Rule(name, severity if severity in WEIGHTS else "MEDIUM", pattern, tuple(str(x).lower() for x in r.get("languages") or ["*"]), title=str(r.get("name") or name)))
    return tuple(out)


def load(spark: SparkSession, folder: str) -> tuple[Rule, ...]:
    """Rules of all JSON and YAML files under folder, by path. Rule files are as few as people write."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("content").cast("string").alias("text"))
    some = rows.where(F.lower("path").rlike(r"\.(?:json|ya?ml)$")).orderBy("path").toLocalIterator()
    return rules_of(spark, (rule for r in some for rule in parsed(r["path"], r["text"])))


def findings(files: DataFrame, rules: tuple[Rule, ...], most: int = 100) -> DataFrame:
    """Findings of rules of one's own, as the grids give them; at most most a file."""
    return scan.grid(files, rules, "custom", most=most)


def hooked(rows: DataFrame, hooks: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """rows after all hooks, each a function from a relation to one; a hook that fails is left out."""
    for hook in hooks:
        try:
            out = hook(rows)
        except Exception as e:  # noqa: BLE001 - a hook of a user must not end a scan
            logging.getLogger(__name__).warning("hook %s is left out: %s", getattr(hook, "__name__", hook), e)
            continue
        rows = out if isinstance(out, DataFrame) else rows
    return rows
