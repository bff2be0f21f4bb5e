"""Structured Streaming over requests: sources, windowed metrics with a watermark, findings seen once, token buckets with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sieveline.operators import control, scan
from sieveline.operators.catalog import Rule
from sieveline.sources.shared import shared_path


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The files at path, a folder or a single file, as a stream; the schema is that of the files. A single file has to be named by a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def request_stream(events: DataFrame) -> DataFrame:
    """Events as requests, with ts as an instant (read as UTC), so that it can carry a watermark."""
    return control.requests(events).withColumn("ts", F.timestamp_micros(control.micros()))


def tool_windows(asked: DataFrame, width: str = "1 day", late: str = "6 hours") -> DataFrame:
    """window_start, tool, calls, denied of each window once the watermark (late behind the newest ts) has passed its end."""
    rows = control.authorised(asked.withWatermark("ts", late))
    out = rows.groupBy(F.window("ts", width), "tool").agg(F.count("*").alias("calls"), F.count_if(~F.col("granted")).alias("denied"))
    return out.select(F.col("window.start").alias("window_start"), "tool", "calls", "denied")


def finding_stream(files: DataFrame, rules: tuple[Rule, ...], late: str = "1 day") -> DataFrame:
    """Findings of files(file_id, path, language, content, ts) as they arrive; one that is sent again within the watermark is dropped."""
    rows = scan.grid(files, rules, "regex", keep=("ts",))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "rule_id", "line", "column"])


def token_buckets(asked: DataFrame, key: str, capacity: float, per_day: float) -> DataFrame:
    """key, event_id, admitted: control.token_bucket() on a stream. The state of a key is its tokens and its last time.

    Requests of one trigger are taken in order of time, then event_id; one that comes in a later trigger but is older refills nothing.
    """
    kind = asked.schema[key].dataType.simpleString()

    def each(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        admitted = []
        for t in rows["t"]:
            tokens = min(float(capacity), tokens + (0.0 if last is None else max(t - last, 0.0)) * float(per_day))
            last = t if last is None else max(t, last)
            admitted.append(tokens >= 1.0)
            tokens -= admitted[-1]
        state.update((tokens, float(last)))
        yield pd.DataFrame({key: rows[key], "event_id": rows["event_id"], "admitted": admitted})

    timed = asked.select(key, "event_id", (F.unix_micros("ts") / 86_400_000_000).alias("t"))
    return timed.groupBy(key).applyInPandasWithState(each, f"`{key}` {kind}, event_id long, admitted boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, append its rows to Parquet in the shared folder, and read them."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
