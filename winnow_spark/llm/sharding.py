"""Sharding by byte-size prefix sums: contiguous shards of near-equal size.

Rows are put in order (``doc_id``; ties by size and checksum, so only rows that
are alike are interchangeable). Each range of that order is summed by itself,
the ranges' totals are added up, and every row so learns how many bytes stand
before it in the whole table. The total is cut at equal targets; a row goes
where its midpoint falls, so a shard misses its target by half a row a side.

All of it is DataFrame code. Only slim rows (id, size, checksum) are shuffled,
and what meets in one place is one total per range, not rows.

Defined results for odd input: a null text has size 1 and checksum 0, as an
empty one; null ids come first; repeated rows are kept and each gets a slot of
its own; an empty table gives an empty result; a text larger than a whole
target lies in one shard and its neighbours may stay empty. Equal texts may
part: the law is one of sizes. Extra columns are not carried: join them on
``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow_spark.llm.workers import quoted
from winnow_spark.session import cut_lineage, read_table

#: Rows to a range, and ranges at most; a range's rows are sorted in one task.
RANGE_ROWS, MAX_RANGES = 200_000, 50_000


def shard_by_bytes(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``."""
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    slim = cut_lineage(docs.select(F.col(quoted(id)).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")))
    order = ["doc_id", "size", "text_crc32"]
    ranges = max(min(MAX_RANGES, -(-slim.count() // RANGE_ROWS)), docs.sparkSession.sparkContext.defaultParallelism)
    ranged = cut_lineage(slim.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))

    # Totals of the ranges, added up in their order: one row a range.
    totals = ranged.groupBy("range").agg(F.sum("size").alias("range_bytes"), F.count("*").alias("range_rows"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    starts = totals.select(
        "range",
        F.coalesce(F.sum("range_bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("range_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("range_bytes").over(every).alias("all_bytes"),
    )
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(starts), "range").select(
        *order,
        "all_bytes",
        (F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("before"),
        (F.col("rows_before") + F.count("*").over(inside)).alias("place"),
    )
    # Twice the midpoint over twice the total, in whole numbers.
    cut = F.expr(f"CAST(((2 * CAST(before AS DECIMAL(30,0)) + size) * {shards}) DIV (2 * CAST(all_bytes AS DECIMAL(30,0))) AS INT)")
    placed = cut_lineage(placed.withColumn("shard", cut).drop("before", "all_bytes"))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot"))


SHARDS = 16


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_by_bytes(docs, SHARDS).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))




#: The checksum is added up byte by byte, from a table made by its rule.
ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
raw AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h)::BIGINT, 2),
    lambda i: ((instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i+1]) - 1)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM raw, steps),
placed AS (
  SELECT doc_id, size, text_crc32, sum(size) OVER w - size AS before, sum(size) OVER () AS whole, row_number() OVER w AS place
  FROM sums WINDOW w AS (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, (((2 * before + size) * {SHARDS}) // (2 * whole))::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM cut
"""
