"""Source files of a folder as the relation files(file_id, path, language, content, ...)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.languages import base_name, detected
from sieveline.sources.shared import saved, ship

#: Folders that a scan leaves out (and all whose names begin with a dot), suffixes and whole names that it reads.
SKIPPED = frozenset("node_modules dist build target __pycache__ coverage vendor venv".split())
SUFFIXES = frozenset(".py .pyw .js .jsx .mjs .cjs .ts .tsx .go .java .kt .rs .c .h .cc .cpp .hpp .cs .rb .php .swift .tf .hcl .yml .yaml .json .sh .bash .sql .dockerfile .toml .md".split())
NAMES = frozenset("Dockerfile dockerfile Makefile go.mod Cargo.toml package.json requirements.txt pyproject.toml".split())
#: Bytes of the largest file that is read, and bytes of a text that are looked at.
MOST_BYTES = 512_000


def normal_path(path: Column) -> Column:
    """Forward slashes, no ./ in front, no doubled slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/"), r"^(?:\./)+", "")


def bounded(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """files with content cut to its first most bytes (a character that the cut parts goes too), and truncated where something was cut."""
    raw = F.encode("content", "UTF-8")
    whole = F.octet_length("content") <= most
    part = F.regexp_replace(F.make_valid_utf8(F.substring(raw, F.lit(1), F.lit(most)).cast("string")), "�+$", "")
    return files.withColumns({"content": F.when(whole, F.col("content")).otherwise(part), "truncated": F.coalesce(~whole, F.lit(False))})


def _at(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if root.startswith("file:") or "://" not in root:
        return pyarrow.fs.LocalFileSystem(), root.removeprefix("file://").removeprefix("file:").rstrip("/")
    fs, at = pyarrow.fs.FileSystem.from_uri(root)
    return fs, at.rstrip("/")


def _dealt(paths: DataFrame) -> DataFrame:
    """paths over a fixed number of tasks: rows of names are so few bytes that Spark would otherwise put all of them, and the files they stand for, into one task."""
    return paths.repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("path"))


def listed(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), size, modified of all files under root but for those in SKIPPED, dotted or skip folders.

    Folders are listed level by level, in tasks; one that is left out is never opened. Spark's own listing is not used, as it passes over names
    that begin with an underscore. A folder that cannot be listed has no files.
    """
    ship(spark)
    hidden = SKIPPED | set(skip)

    def each(batches):
        fs, at = _at(root)
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                try:
                    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{at}/{folder}".rstrip("/")))
                except OSError:
                    continue
                for f in found:
                    is_folder = f.type == pyarrow.fs.FileType.Directory
                    if not (is_folder and (f.base_name in hidden or f.base_name.startswith("."))):
                        rows.append((f"{folder}/{f.base_name}".lstrip("/"), is_folder, 0 if is_folder else f.size, None if is_folder else f.mtime))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")), strict=True)], names=["path", "folder", "size", "modified"])

    level, files = spark.createDataFrame([("",)], "path string"), []
    while level.limit(1).count():
        found = saved(level.mapInArrow(each, "path string, folder boolean, size long, modified timestamp"), "listing")
        files.append(found.where("not folder").drop("folder"))
        level = _dealt(found.where("folder").select("path"))
    return reduce(DataFrame.unionByName, files)


def scan_folder(spark: SparkSession, root: str, skip: tuple[str, ...] = (), suffixes: frozenset[str] = SUFFIXES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """file_id, path (below root), language, content, modified of the source files under root, on any file system that pyarrow opens.

    Left out are files of other suffixes and names and those over most_bytes: names and sizes are checked before a file is read. Bytes that are no
    UTF-8 become replacement characters; a file that cannot be read has null content. file_id is a hash of the path.
    """
    name = base_name(F.col("path"))
    wanted = name.isin(*NAMES) | F.concat(F.lit("."), F.lower(F.element_at(F.split(name, r"\."), -1))).isin(*suffixes)

    def each(batches):
        fs, at = _at(root)

        def read(path: str) -> str | None:
            try:
                with fs.open_input_stream(f"{at}/{path}") as f:
                    return f.read().decode("utf-8", "replace")
            except OSError:
                return None

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([read(p) for p in part.column(0).to_pylist()], pa.string())], names=["path", "modified", "content"])

    found = _dealt(listed(spark, root, skip).where(wanted & (F.col("size") <= most_bytes)).select("path", "modified"))
    rows = found.mapInArrow(each, "path string, modified timestamp, content string").withColumn("path", normal_path(F.col("path")))
    return rows.select(F.xxhash64("path").alias("file_id"), "path", detected(F.col("path"), F.col("content")).alias("language"), "content", "modified")


def changed_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Of files those whose path is in changed(path, status): added, copied, modified or renamed ones; deleted ones have no file."""
    some = changed.where(F.upper(F.left("status", F.lit(1))).isin("A", "C", "M", "R")).select(normal_path(F.col("path")).alias("path")).distinct()
    return files.join(some, "path", "left_semi")


def name_status(spark: SparkSession, path: str) -> DataFrame:
    """path, status of the lines of a `git diff --name-status` listing; a renamed or copied file stands under its new name."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.size(parts) > 1).select(F.element_at(parts, -1).alias("path"), F.get(parts, F.lit(0)).alias("status"))


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files that cache(path, sha256, modified) lacks or has with other content; a file of the same time is taken as it was."""
    now = files.withColumn("sha256", F.sha2(F.encode("content", "UTF-8"), 256))
    old = cache.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha"), F.col("modified").alias("_at"))
    same = (F.col("path") == F.col("_path")) & ((F.col("sha256") == F.col("_sha")) | (F.col("modified") == F.col("_at")))
    return now.join(old, same, "left_anti")
