"""Incremental scans of a stream of files: only what the cache lacks is scanned, and a batch that runs twice leaves the same tables.

Each batch writes folders of its own (batch=<number>) of the cache, the findings and the counts, and reads the cache of earlier batches only. So a batch
that was killed anywhere, and runs again, meets the same cache as the first time and replaces its own folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import scan
from sieveline.operators.catalog import Rule

#: Seconds that two times of a file may differ by and count as one.
SAME_TIME = 1e-6
#: Findings that a cache keeps of a file.
RESULT = "array<struct<rule_id:string,severity:string,line:int,column:int,excerpt:string>>"
ENTRY = f"path string, sha256 string, modified timestamp, result {RESULT}"


def opened(spark: SparkSession, root: str) -> None:
    """Make the empty tables of a new cache; one that is there stays."""
    for name, schema in (("cache", ENTRY), ("counts", "hits long, misses long")):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}/batch=-1")


def entries(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """path, sha256, modified, result: of each path the entry of the last batch (of those before one, where named)."""
    rows = spark.read.schema(f"{ENTRY}, batch long").option("basePath", f"{root}/cache").parquet(f"{root}/cache")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.groupBy("path").agg(F.max_by(F.struct("sha256", "modified", "result"), "batch").alias("e")).select("path", "e.*")


def scanned(batch: DataFrame, number: int, rules: tuple[Rule, ...], root: str, most: int | None = scan.MOST_FINDINGS) -> None:
    """One batch of files(path, language, content, modified): entries for what the cache lacks, findings of all, hits and misses.

    An entry fits if path and content hash are equal and times differ by less than SAME_TIME. Of equal paths in a batch the last modified is scanned, of those the one with
    the greatest hash. Null contents are empty.
    """
    spark = batch.sparkSession
    newest = batch.withColumns({"content": F.coalesce("content", F.lit("")), "sha256": F.sha2(F.encode(F.coalesce("content", F.lit("")), "UTF-8"), 256)})
    newest = newest.groupBy("path").agg(F.max_by(F.struct("language", "content", "modified", "sha256"), F.struct("modified", "sha256")).alias("f")).select("path", "f.*")
    old = entries(spark, root, number).select("path", F.col("sha256").alias("_sha"), F.col("modified").alias("_at"), F.col("result").alias("_result"))
    apart = F.abs(F.unix_micros("modified") - F.unix_micros("_at")) / 1e6
    joined = newest.join(old, "path", "left").withColumn("hit", F.coalesce((F.col("sha256") == F.col("_sha")) & (apart < SAME_TIME), F.lit(False)))
    # the join is written, so that hits and misses of one batch come from one look at the cache
    joined.write.mode("overwrite").parquet(f"{root}/looked-up/batch={number}")
    looked = spark.read.parquet(f"{root}/looked-up/batch={number}")
    missed = looked.where("not hit")
    found = scan.grid(missed.withColumn("file_id", F.col("path")), rules, "regex", most=most)
    by_path = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rule_id", "severity", "line", "column", "excerpt"))).alias("result"))
    fresh = missed.select("path", "sha256", "modified").join(by_path, "path", "left").withColumn("result", F.coalesce("result", F.array().cast(RESULT)))
    fresh.write.mode("overwrite").parquet(f"{root}/cache/batch={number}")
    new = spark.read.schema(ENTRY).parquet(f"{root}/cache/batch={number}")
    all_ = looked.where("hit").select("path", F.col("_result").alias("result")).unionByName(new.select("path", "result"))
    all_.select("path", F.inline("result")).write.mode("overwrite").parquet(f"{root}/findings/batch={number}")
    looked.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).write.mode("overwrite").parquet(f"{root}/counts/batch={number}")


def run(stream: DataFrame, rules: tuple[Rule, ...], root: str, progress: str) -> None:
    """Scan what a stream of files has now into the tables under root, which opened() made; progress is the stream's checkpoint folder."""
    query = stream.writeStream.foreachBatch(lambda batch, number: scanned(batch, number, rules, root)).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def statistics(spark: SparkSession, root: str) -> DataFrame:
    """batch, entries (paths known after it), hits, misses, hit_rate (three digits) of every batch."""
    counts = spark.read.schema("hits long, misses long, batch long").parquet(f"{root}/counts").where("batch >= 0")
    cache = spark.read.schema(f"{ENTRY}, batch long").parquet(f"{root}/cache").groupBy("path").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count("*").alias("new"))
    known = counts.alias("c").join(cache.alias("k"), F.col("k.batch") <= F.col("c.batch"), "left").groupBy("c.batch", "hits", "misses").agg(F.coalesce(F.sum("new"), F.lit(0)).alias("entries"))
    return known.select("batch", "entries", "hits", "misses", F.round(F.col("hits") / F.greatest(F.lit(1), F.col("hits") + F.col("misses")), 3).alias("hit_rate"))


def compacted(spark: SparkSession, root: str, to: str) -> None:
    """The cache with one entry a path as a new cache under another root, for a stream that starts anew there."""
    opened(spark, to)
    entries(spark, root).write.mode("overwrite").parquet(f"{to}/cache/batch=-1")
