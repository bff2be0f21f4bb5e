"""Data sources of a session: folders of rule files, read; folders of SARIF documents, read and written.

register(spark) makes both known; then spark.read.format(RULES).load(folder), spark.read.format(SARIF).load(folder) and
documents.write.format(SARIF).mode("append").save(folder). A folder must be one that driver and executors share; local paths and the
addresses that pyarrow's file systems know are taken. Names that begin with an underscore or a dot are no data.

Readers do not take filters from Spark: this version keeps the reader with its filters for later queries of the same relation, which then lack rows. What the reader is to leave
out is said by options of the load instead, each a value or a JSON list of values: option("level", "error"), option("files", '["a.sarif", "b.sarif"]').
"""

from __future__ import annotations

import json
import logging
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sieveline.operators import custom
from sieveline.sources.shared import ship

RULES, SARIF = "sieveline-rules", "sieveline-sarif"
#: Bytes of files that one task reads, and after which a writer begins a new file; a file is read by one task.
PART_BYTES = 32 << 20
LINES = ".sarifl"


def register(spark: SparkSession) -> None:
    """Make both sources known to the session."""
    ship(spark)
    for source in (RuleFolder, SarifFolder):
        spark.dataSource.register(source)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder.rstrip("/") or "/"))


def values(option: str) -> frozenset[str]:
    """The values that an option names: those of a JSON list, or itself."""
    return frozenset(map(str, json.loads(option))) if option.lstrip().startswith("[") else frozenset([option])


class Files(InputPartition):
    """Paths that one task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class FolderReader(DataSourceReader):
    """Rows of the files with some suffixes under a folder, those with the values that options name for the columns of EXACT; option files names paths below the folder, which alone are opened."""

    SUFFIXES: tuple[str, ...] = ()
    EXACT: tuple[str, ...] = ()

    def __init__(self, options, columns: list[str]):
        self.folder, self.columns = options["path"], columns
        self.wanted = {c: values(options[c]) for c in self.EXACT if options.get(c) is not None}
        self.files = values(options["files"]) if options.get("files") is not None else None

    def partitions(self) -> list[InputPartition]:
        files, root = opened(self.folder)
        if files.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no folder {self.folder}")
        found = sorted((i.path, i.size) for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file)
        parts, size = [], 0
        for path, n in found:
            below = path[len(root) :].strip("/")
            if below.lower().endswith(self.SUFFIXES) and not any(x[0] in "_." for x in below.split("/")) and (self.files is None or below in self.files):
                if not parts or size + n > PART_BYTES:
                    parts.append([])
                    size = 0
                parts[-1].append(below)
                size += n
        return [Files(p) for p in parts] or [Files([])]

    def takes(self, column: str, value) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, root = opened(self.folder)
        for path in partition.paths:
            with files.open_input_stream(f"{root}/{path}", compression=None) as stream:
                for row in self.rows(path, stream):
                    row["path"] = path
                    if all(self.takes(c, row.get(c)) for c in self.wanted):
                        yield tuple(row.get(c) for c in self.columns)

    def rows(self, path: str, stream) -> Iterator[dict]:
        raise NotImplementedError


class RuleReader(FolderReader):
    SUFFIXES, EXACT = (".json", ".yaml", ".yml"), ("id", "severity", "type")

    def rows(self, path: str, stream) -> Iterator[dict]:
        text = lambda v: None if v is None else str(v)
        for place, r in enumerate(custom.parsed(path, stream.read().decode("utf-8", "replace"))):
            languages = r.get("languages")
            yield {
                "place": place, "id": text(r.get("id")), "name": text(r.get("name")), "severity": str(r.get("severity") or "MEDIUM").upper(),
                "pattern": text(r.get("pattern") or r.get("query")), "type": str(r.get("type") or "regex").lower(), "enabled": bool(r.get("enabled", True)),
                "languages": [str(x) for x in languages] if isinstance(languages, list) else [str(languages)] if languages else None,
            }


class RuleFolder(DataSource):
    """path, place, id, name, severity, pattern, type, enabled, languages of every rule in the JSON and YAML files under a folder, as they are written there.

    A file that does not parse has none. Rows are mappings for custom.rules_of(), which leaves out what is no rule.
    """

    COLUMNS = "path string, place int, id string, name string, severity string, pattern string, type string, enabled boolean, languages array<string>"

    @classmethod
    def name(cls) -> str:
        return RULES

    def schema(self) -> str:
        return self.COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return RuleReader(self.options, schema.fieldNames())


def _first(value, *keys):
    """What stands under keys, names or numbers, or None where one is missing."""
    for k in keys:
        if isinstance(k, int):
            value = value[k] if isinstance(value, list) and len(value) > k else None
        else:
            value = value.get(k) if isinstance(value, dict) else None
    return value


def _kind(value, kind):
    return value if isinstance(value, kind) and not isinstance(value, bool) else None


class SarifReader(FolderReader):
    SUFFIXES, EXACT = (".sarif", ".sarif.json", LINES), ("tool", "rule_id", "level", "severity", "uri")

    def rows(self, path: str, stream) -> Iterator[dict]:
        texts = _lines(stream) if path.lower().endswith(LINES) else [stream.read()]
        for document, text in enumerate(texts):
            try:
                runs = json.loads(text).get("runs")
                if not isinstance(runs, list):
                    raise ValueError("no runs")
            except (ValueError, AttributeError) as e:
                logging.getLogger(__name__).warning("%s, document %d: %s", path, document, e)
                yield {"document": document, "problem": str(e)}
                continue
            for run, r in enumerate(runs):
                rules = _kind(_first(r, "tool", "driver", "rules"), list) or []
                for place, x in enumerate(_kind(_first(r, "results"), list) or []):
                    yield {"document": document, "run": run, "place": place, "tool": _kind(_first(r, "tool", "driver", "name"), str)} | self.result(x, rules)

    def result(self, x, rules: list) -> dict:
        at = _first(x, "locations", 0, "physicalLocation")
        number = _kind(_first(x, "ruleIndex"), int)
        of = rules[number] if number is not None and 0 <= number < len(rules) else None
        marks = _first(x, "partialFingerprints")
        return {
            "rule_id": _kind(_first(x, "ruleId"), str) or _kind(_first(of, "id"), str),
            "level": _kind(_first(x, "level"), str) or _kind(_first(of, "defaultConfiguration", "level"), str) or "warning",
            "severity": _kind(_first(x, "properties", "severity"), str), "message": _kind(_first(x, "message", "text"), str),
            "uri": _kind(_first(at, "artifactLocation", "uri"), str), "line": _kind(_first(at, "region", "startLine"), int), "column": _kind(_first(at, "region", "startColumn"), int),
            "excerpt": _kind(_first(at, "region", "snippet", "text"), str), "fingerprint": next((v for _, v in sorted(marks.items()) if isinstance(v, str)), None) if isinstance(marks, dict) else None,
        }


def _lines(stream) -> Iterator[bytes]:
    """Lines of a stream that are not blank; one block and one line are in memory."""
    rest = []
    while block := stream.read(1 << 20):
        *whole, last = block.split(b"\n")
        if whole:
            whole[0] = b"".join([*rest, whole[0]])
            rest = []
            yield from (x for x in whole if x.strip())
        rest.append(last)
    if (last := b"".join(rest)).strip():
        yield last


class Written(WriterCommitMessage):
    """Names of the files that one task wrote."""

    def __init__(self, names: list[str]):
        self.names = names


class SarifWriter(DataSourceArrowWriter):
    """Documents as lines of files. Tasks write into a folder of this job; only what successful tasks name is moved into place, so a task that is lost or runs twice
    leaves nothing. In overwrite mode the files that were there go once all of the new ones are written. The driver moves one file a task or PART_BYTES."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        files, root = opened(self.folder)
        files.create_dir(f"{root}/{self.job}", recursive=True)
        task = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        names, out, size = [], None, 0
        for batch in iterator:
            for document in batch.column("document"):
                if (text := document.as_py()) is None:
                    continue
                data = (json.dumps(json.loads(text), ensure_ascii=False) if "\n" in text else text).encode() + b"\n"
                if out is None or size + len(data) > PART_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"{task}-{len(names)}{LINES}")
                    out, size = files.open_output_stream(f"{root}/{self.job}/{names[-1]}"), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        files, root = opened(self.folder)
        files.create_dir(f"{root}/{self.job}", recursive=True)
        if self.overwrite:
            for i in files.get_file_info(fs.FileSelector(root)):
                if i.is_file and i.base_name.endswith(SarifReader.SUFFIXES):
                    files.delete_file(i.path)
        for name in (n for m in messages if m is not None for n in m.names):
            files.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        files.delete_dir(f"{root}/{self.job}")
        files.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages) -> None:
        files, root = opened(self.folder)
        if files.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")


class SarifFolder(DataSource):
    """path, document (number in its file), run, place, tool, rule_id, level, severity, message, uri, line, column, excerpt, fingerprint, problem: a row for each result.

    Read from .sarif and .sarif.json files, one document each, and .sarifl files, one a line. What a result does not say is null; its rule's id and level stand in for its own. A document
    that does not parse is one row with its problem. Written from a column document; null documents are left out, a text of many lines becomes one.
    """

    COLUMNS = "path string, document int, run int, place int, tool string, rule_id string, level string, severity string, message string, uri string, line long, column long, excerpt string, fingerprint string, problem string"

    @classmethod
    def name(cls) -> str:
        return SARIF

    def schema(self) -> str:
        return self.COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return SarifReader(self.options, schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> SarifWriter:
        if "document" not in schema.fieldNames():
            raise ValueError("a column named document is needed")
        return SarifWriter(self.options["path"], overwrite)
