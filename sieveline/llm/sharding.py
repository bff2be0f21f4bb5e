"""Balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import join_skewed, ranked, saved

#: Rows of one cell of a ranking, about, and of one bucket of links.
CELL_ROWS, BUCKET_ROWS = 128, 1024


def _cells(state: DataFrame, buckets: int) -> DataFrame:
    """bucket keeps the documents of a link together; spread splits a large link."""
    return state.withColumn("bucket", F.pmod(F.xxhash64("link"), F.lit(buckets))).withColumn("spread", F.pmod(F.xxhash64("doc_id", "link"), F.ceil(F.col("n_link") / CELL_ROWS)))


def _kept_within_quotas(state: DataFrame, shards: int, n: int) -> DataFrame:
    """Give each row a shard: the one it wants if its rank there is within the quota, else one with free places.

    Quotas are n // shards, one more for the first n % shards. Rows that want a full shard are ranked together, the links'
    documents side by side, and fill the free places in order, so a link that has to be cut is cut into few parts.
    """
    spark = state.sparkSession
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("wanted") + 1)
    placed = saved(ranked(state, "wanted", ["urgency", "bucket", "spread"], ["link", "doc_id", "text_crc32"], "place").withColumn("full", F.col("place") >= quota), "placed")
    stay = placed.where(~F.col("full")).withColumn("shard", F.col("wanted"))
    counts = {r["wanted"]: r["n"] for r in stay.groupBy("wanted").agg(F.count("*").alias("n")).collect()}
    free, at = [], 0
    for s in range(shards):
        if room := quotas[s] - counts.get(s, 0):
            free.append((s, at, at + room))
            at += room
    if not free:
        return stay.drop("full", "place")
    to = F.lit(None).cast("int")
    for s, lo, hi in free:
        to = F.when((F.col("turn") >= lo) & (F.col("turn") < hi), F.lit(s)).otherwise(to)
    over = ranked(placed.where("full").withColumn("all", F.lit(0)), "all", ["bucket", "spread"], ["link", "doc_id", "text_crc32"], "turn").withColumn("shard", to).drop("all", "turn")
    return stay.unionByName(over).drop("full", "place")


def balanced_shards(rows: DataFrame, shards: int, rounds: int = 3) -> DataFrame:
    """rows (doc_id, link, other columns, text_crc32 among them) with shard and slot added: shard sizes differ by one row at most.

    Documents that share a link are neighbours. They start in shards by hash. In each round every link's documents want the
    shard that holds most of them (on a tie the one whose hash with the link is smallest), larger parties first; unlinked
    documents want to stay and give way. Quotas hold after every round. A link is joined as counts per shard, never as pairs;
    one larger than a shard fills it and goes on in the next. Documents with a null link are unlinked. Repeated rows are
    rows of their own. slot numbers the rows of a shard from 0. An empty table gives an empty result.
    """
    alone = F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), F.rand(7).cast("string"))
    start = saved(rows.withColumn("link", F.coalesce(F.col("link"), alone)), "rows")
    n = start.count()
    buckets = max(256, n // BUCKET_ROWS)
    sizes = saved(start.groupBy("link").agg(F.count("*").alias("n_link")), "links")
    state = _cells(join_skewed(start, sizes, ["link"], "n_link", n), buckets).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int"))
    state = saved(state, "state")
    for _ in range(rounds):
        linked = state.where("n_link > 1")
        counts = linked.groupBy("link", "shard").agg(F.count("*").alias("c"), F.first("n_link").alias("all"))
        party = F.struct("c", (-F.xxhash64("link", "shard")).alias("tie"))
        wants = saved(counts.groupBy("link").agg(F.max_by("shard", party).alias("wanted"), F.max("c").alias("most"), F.first("all").alias("all")), "wants")
        moving = join_skewed(linked, wants, ["link"], "all", n).drop("all").withColumn("urgency", -F.floor(F.log2(F.col("most"))).cast("int")).drop("most")
        staying = state.where("n_link = 1").withColumn("wanted", F.col("shard")).withColumn("urgency", F.lit(1))
        state = saved(_kept_within_quotas(moving.unionByName(staying).drop("shard"), shards, n).drop("wanted", "urgency"), "state")
    return ranked(state, "shard", ["bucket", "spread"], ["link", "doc_id", "text_crc32"], "slot").drop("bucket", "spread", "n_link")


def cut_pairs(sharded: DataFrame) -> DataFrame:
    """Pairs of linked documents in different shards, and all linked pairs, from counts."""
    c = sharded.where("link is not null").groupBy("link", "shard").agg(F.count("*").alias("c")).groupBy("link").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("within"))
    return c.agg(F.sum((F.col("n") * F.col("n") - F.col("within")) / 2).alias("cut"), F.sum((F.col("n") * F.col("n") - F.col("n")) / 2).alias("pairs"))


def document_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and link (equal texts share one; a null text has none) of documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(F.encode(F.col("text"), "UTF-8")).alias("link"))


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 3) -> DataFrame:
    """Shards of documents with equal texts kept together where the quotas allow: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    law is 'rows': the shards' row counts differ by one at most; grown_shard is null. A null text has size 1, crc 0 and no
    neighbours; an empty text is a text. Other columns of docs are ignored.
    """
    out = balanced_shards(document_rows(docs), shards, rounds)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
