"""Exact deduplication by progressive refinement, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Pass one reads each text for its byte
length and the hash of a short prefix; lengths held by one row, then (length, prefix) pairs held by
one row, leave the race. Only survivors have their whole content hashed (SHA-256), grouped, and
joined back, rows of a large group dealt over many tasks. Text itself never crosses the network: pass two decides
map-side, by a broadcast bitmap of bounded size, which rows survive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import ascii_lower, key_filter, materialise, spread_join, with_membership, without_ids


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, hash_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text equals the empty text. A null id
    never wins over a number; a group of null ids only keeps null. Rows repeated with the same id and
    text count in group_size and share one verdict. An empty table gives an empty result. Other
    columns are ignored, whatever their names. ``text_sha256`` is null for rows that left the race
    before their content was read, unless ``hash_all`` asks for every digest.
    """
    base = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.col(text_col)).alias("_text"))
    probe = [F.octet_length("_text").alias("_len"), F.xxhash64(F.substring("_text", 1, prefix_chars)).alias("_prefix")]
    sig = materialise(base.select(*probe), "signatures")
    lengths = sig.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Counts by (length, prefix) are small; the length test then runs on them, not on rows.
    pairs = sig.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    alive = materialise(pairs.join(lengths.select("_len"), "_len", "left_semi").select(F.xxhash64("_len", "_prefix").alias("k")), "alive")
    marked = with_membership(base.select("*", *probe), key_filter(alive, "k"), F.xxhash64("_len", "_prefix"), "_alive")
    content = F.sha2(F.encode("_text", "UTF-8"), 256)
    hashed = materialise(
        marked.select("_id", "_alive", (content if hash_all else F.when(F.col("_alive"), content)).alias("_full")), "hashed"
    )
    survivors = hashed.where("_alive").select("_id", "_full")
    groups = materialise(survivors.groupBy("_full").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")), "groups")
    out = spread_join(survivors, groups, ["_full"], "_n", F.xxhash64("_id")).select("_id", "_keep", "_n", "_full")
    alone = hashed.where("NOT _alive").select("_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"), "_full")
    return out.unionByName(alone).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_full").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that repeat an id share its fate, so identical rows stay together."""
    return without_ids(docs, exact_dedup(docs, id_col, text_col).where("NOT kept").select(id_col), id_col)
