"""What the operators of this package share: reading tables, cutting lineage, shipping code, ranking rows."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, whatever the driver's working directory is."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="sieveline-"), "sieveline_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


#: Rows in a batch that a Python worker gets at once, where the session has Spark's own 10,000: texts are long.
BATCH_ROWS = 2000


def _released() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(each):
    """each, a function from batches to batches, which gives memory back when its task ends: workers live on between stages."""

    def run(batches):
        try:
            yield from each(batches)
        finally:
            _released()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; a new local one only where a single JVM runs all."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sieveline-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later steps start from files, not from lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if df, which must be cheap to count, has at most so many rows; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_row_key(docs: DataFrame, text_hash) -> tuple[DataFrame, list[str]]:
    """docs with three columns that are equal for rows equal in doc_id (null too) and text hash, and their names."""
    names = free_names(docs, "id", "none", "th")
    doc_id = F.col("doc_id").cast("long")
    return docs.withColumns(dict(zip(names, (F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), text_hash), strict=True))), names


def without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """docs, all columns, but for rows whose doc_id and text hash th stand in drop. While drop is small it is broadcast."""
    some, keys = with_row_key(drop.select("doc_id", F.col("th").alias("_text")), F.col("_text"))
    keyed, names = with_row_key(docs, F.xxhash64("text"))
    some = saved(some.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).distinct(), "drop")
    return keyed.join(small(some, 2_000_000), names, "left_anti").select(*docs.columns)


#: Keys that join_skewed() may broadcast, at most.
MOST_HOT = 2000


def join_skewed(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of left with right, which has each key once and says in column rows how many rows of left have it (or more).

    Of left's total rows a key over total / MOST_HOT is hot, so there are fewer than MOST_HOT hot keys: these rows of right are broadcast,
    and hot rows of left stay where they are. The others meet in a shuffle in which no key is large. Both sides should be saved tables. Keys must
    not be null.
    """
    bound = total // MOST_HOT + 1
    hot = F.broadcast(right.where(F.col(rows) > bound))
    cold = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(rows) <= bound), keys)
    return left.join(hot, keys).unionByName(cold)


def ranked(df: DataFrame, group: str, cell: list[str], order: list, name: str) -> DataFrame:
    """Number the rows of each group from 0 by (cell, order), without a task that holds a whole group.

    Rows are numbered within their cell; a cell starts after the rows of all earlier cells of its group. Cells are counted, the counts
    range-partitioned and written with the number of their part, so that only one sum per part and group is added up in one task. The caller
    makes the cells small. Columns of cell must not be null.
    """
    keys = [group, *cell]
    counts = saved(df.groupBy(*keys).agg(F.count("*").alias("_n")).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "cells")
    parts = counts.groupBy(group, "_part").agg(F.sum("_n").alias("_m"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(group, "_part", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_base"))
    before = Window.partitionBy(group, "_part").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(base), [group, "_part"])
    starts = starts.select(*keys, (F.col("_base") + F.col("_before")).alias("_start"))
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_own", F.row_number().over(own) - 1).join(starts, keys).withColumn(name, F.col("_start") + F.col("_own")).drop("_start", "_own")
