"""Global shuffle of a table into shards: seeded scatter into memory-sized buckets, then Fisher-Yates in each bucket."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm.common import scratch


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


@dataclass(frozen=True)
class ShuffledShards:
    """Rows dealt into ``shards`` files sets in random order, counts at most one apart (law ``rows``).

    Pass 1 scatters the rows by a seeded hash into as many buckets as the bytes
    of the table need at ``bucket_bytes`` each, so a bucket fits one task; a large
    cluster sets it to a share of an executor's memory.  Pass
    2 permutes each bucket (``shuffle`` of an array is an in-memory Fisher-Yates
    shuffle) and writes it.  The running number of a row, over all buckets in
    order, decides its shard: shard ``s`` holds the numbers from
    ``floor(s * n / shards)`` on, and its slots count from 0 without gaps.
    """

    shards: int = 8
    seed: int = 20
    bucket_bytes: int = 16 << 20

    def write(self, rows: DataFrame, size: Column, path: str, key: str = "doc_id") -> None:
        """Write ``rows`` with columns ``shard`` and ``slot`` added as parquet, one folder per shard.

        The scatter hashes the key and the row's place in the input, so a key
        that repeats in a third of all rows is spread as well.  ``rows`` must be
        a stored table or another plan that gives the same rows in the same
        order each time; the written counts are compared with the planned ones,
        and a difference is an error.  Nulls are hashed like other values.
        Columns named ``shard`` or ``slot`` are replaced.  An empty table gives
        an empty folder with the schema.
        """
        names = [c for c in rows.columns if c not in ("shard", "slot")]
        total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
        buckets = max(1, -(-int(total["bytes"]) // self.bucket_bytes))
        placed = F.pmod(F.xxhash64(F.lit(self.seed), F.col(key), F.monotonically_increasing_id()), F.lit(buckets))
        counts = rows.select(placed.alias("bucket")).groupBy("bucket").count()
        before = self._numbers_before(counts)
        item = F.struct(F.xxhash64(F.lit(~self.seed), F.col(key)).alias("mark"), F.struct(*names).alias("row"))
        gathered = rows.select(placed.alias("bucket"), item.alias("item"))
        # one task per bucket (up to 100,000 tasks), so that a task holds few buckets at a time
        gathered = gathered.repartition(min(buckets, 100_000), "bucket").groupBy("bucket").agg(F.collect_list("item").alias("items"))
        # a fixed order before the shuffle: a repeated task then gives the same permutation
        ordered = F.array_sort("items", lambda x, y: F.when(x["mark"] < y["mark"], -1).when(x["mark"] > y["mark"], 1).otherwise(0))
        permuted = gathered.join(before, "bucket").sortWithinPartitions("bucket").select("before", F.shuffle(ordered, F.lit(self.seed)).alias("items"))
        numbered = permuted.select("before", F.posexplode("items").alias("pos", "item")).select("item.row.*", F.expr("before + pos").alias("number"))
        n = total["rows"]
        shard = F.expr(f"CAST(((number + 1) * {self.shards} - 1) DIV {max(n, 1)} AS INT)")
        slot = F.expr(f"number - (shard * {n}L) DIV {self.shards}")
        numbered.withColumn("shard", shard).withColumn("slot", slot).drop("number").write.partitionBy("shard").parquet(path)
        written = rows.sparkSession.read.schema(numbered.drop("number").schema.add("slot", "long").add("shard", "integer")).parquet(path)
        seen = written.agg(F.count("*").alias("rows"), F.sum(F.col("slot") + 1).alias("slots")).first()
        sizes = [(s + 1) * n // self.shards - s * n // self.shards for s in range(self.shards)]
        if (seen["rows"], seen["slots"] or 0) != (n, sum(x * (x + 1) // 2 for x in sizes)):
            raise RuntimeError("the input gave other rows when it was read again; store it first")

    @staticmethod
    def _numbers_before(counts: DataFrame) -> DataFrame:
        """``(bucket, before)``: rows in all earlier buckets, summed in two levels so that no task gets all buckets."""
        grouped = counts.withColumn("group", F.expr("bucket DIV 1024"))
        inner = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        outer = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
        sums = grouped.groupBy("group").agg(F.sum("count").alias("sum"))
        starts = sums.select("group", F.coalesce(F.sum("sum").over(outer), F.lit(0)).alias("start"))
        return grouped.join(starts, "group").select("bucket", (F.col("start") + F.coalesce(F.sum("count").over(inner), F.lit(0))).alias("before"))


def sharded_documents(docs: DataFrame, plan: ShuffledShards | None = None) -> DataFrame:
    """Documents (``doc_id``, ``text``) written into shuffled shards and read back with ``shard`` and ``slot``."""
    plan = plan or ShuffledShards()
    path = scratch(docs.sparkSession, "shards")
    rows = docs.select("doc_id", "text")
    plan.write(rows, text_bytes(F.col("text")), path)
    return docs.sparkSession.read.schema(rows.schema.add("slot", "long").add("shard", "integer")).parquet(path)
