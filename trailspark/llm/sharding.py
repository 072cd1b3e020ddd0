"""Proportional stratified interleaving into shards, law ``rows``.

Rows are shuffled by a seeded hash and ranked within their source; the fractional rank
``(rank + offset) / rows of the source``, with an offset in [0, 1) from the source's hash, puts every source evenly over
[0, 1), so consecutive cuts of the order by fractional rank match the mixture, and sources of one row spread too. Both rankings are exact and distributed: a source
is cut into hash buckets and the unit interval into equal cells, each small enough for one task, and
the offset of a bucket is a prefix sum over counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import materialise

#: Rows a task ranks at once.
BUCKET_ROWS = 5_000



def _offsets(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot and the ``carry`` columns.

    size is the text's UTF-8 bytes (null: none) plus 1. Shard counts differ by one at most; slot
    counts from 0 within a shard. A null source is a source of its own, null ids and null texts are
    ordinary values, repeated rows get slots of their own, fewer rows than shards leave shards empty,
    and an empty table gives no rows.
    """
    carry = carry or []
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("_size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_crc"),
        *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)],
    ).withColumn("_h", F.xxhash64(F.lit(seed), "_id", "_crc", "_size"))
    rows = materialise(rows, "rows")
    totals = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_total"))
    sized = rows.join(F.broadcast(totals) if _few(totals) else totals, rows["_source"].eqNullSafe(totals["_source"])).drop(totals["_source"])
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_total") / BUCKET_ROWS)).cast("long")
    sized = sized.withColumn("_bucket", F.floor((F.shiftrightunsigned("_h", 32) * buckets) / F.lit(float(1 << 32))).cast("long"))
    order = ["_h", "_id", "_crc"]
    in_bucket = Window.partitionBy("_source", "_bucket").orderBy(F.shiftrightunsigned("_h", 1), *order)
    counts = _offsets(sized.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n")), ["_source"], "_bucket").select(
        F.col("_source").alias("_s2"), F.col("_bucket").alias("_b2"), "_before")
    ranked = sized.withColumn("_r", F.row_number().over(in_bucket))
    ranked = ranked.join(counts, ranked["_source"].eqNullSafe(counts["_s2"]) & (ranked["_bucket"] == counts["_b2"])).withColumn(
        "_rank", F.col("_before") + F.col("_r") - 1)
    # A source's rows are even, and begin where its hash says, so that small sources do not meet in the middle.
    begin = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_source"), 33) / F.lit(float(1 << 31))
    ranked = ranked.withColumn("_frac", (F.col("_rank") + begin) / F.col("_total"))
    ranked = materialise(ranked.select("_id", "_size", "_crc", "_source", "_frac", *[c for c in rows.columns if c.startswith("_carry_")]), "ranked")
    n = totals.agg(F.sum("_total")).first()[0] or 0
    cells = max(1, -(-n // BUCKET_ROWS))
    celled = ranked.withColumn("_cell", F.least(F.lit(cells - 1), F.floor(F.col("_frac") * cells)).cast("long"))
    per_cell = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    cell_offsets = _offsets(per_cell.withColumn("_one", F.lit(0)), ["_one"], "_cell").select(F.col("_cell").alias("_c2"), "_before")
    in_cell = Window.partitionBy("_cell").orderBy("_frac", F.col("_source").asc_nulls_last(), "_id", "_crc")
    placed = celled.withColumn("_r", F.row_number().over(in_cell)).join(cell_offsets, F.col("_cell") == F.col("_c2"))
    placed = placed.withColumn("_pos", F.col("_before") + F.col("_r") - 1)
    shard = F.expr(f"_pos * {shards} div {max(1, n)}")
    placed = placed.withColumn("_shard", shard)
    # The first position of shard s is ceil(s * n / shards).
    first = F.expr(f"(_shard * {n} + {shards - 1}) div {shards}")
    return placed.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").cast("int").alias("shard"), (F.col("_pos") - first).cast("long").alias("slot"),
        *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)],
    )


def _few(df: DataFrame, limit: int = 10_000) -> bool:
    """A broadcast is used for at most ``limit`` rows of two columns; beyond, Spark shuffles."""
    return df.limit(limit + 1).count() <= limit


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write one folder per shard. Its files hold ranges of slots, in slot order; several tasks write a large shard."""
    carry = [c for c in docs.columns if c not in (options.get("id_col", "doc_id"), "shard", "slot", "size", "text_crc32")]
    placed = shard_rows(docs, carry=carry, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
