"""Shared helpers: shared-folder tables, bounded membership filters and text normalisation."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.tables import delete_path, drop_table, materialise, new_path, release, shared_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed by the task: the separators of words, and what a word is made of.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def worker_state(key, make):
    """What ``make`` gives, kept for later tasks of the Python worker; functions sent by value lose their modules' globals with each task.

    A worker serves one operator after another, so a state of another key is dropped: at most one is held.
    """
    cache = sys.__dict__.get("_trailspark_cache", {})
    if key not in cache:
        del cache
        drop_worker_state()
        cache = sys.__dict__["_trailspark_cache"] = {key: make()}
    return cache[key]


def drop_worker_state() -> None:
    """For functions without a state: what an earlier operator left in the Python worker, which would add to their memory, and
    free memory that its allocators hold go back to the system."""
    sys.__dict__.pop("_trailspark_cache", None)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def text_in(batch: pa.RecordBatch, column) -> pa.Array:
    """A column of a batch, or with (column, position) a field of its structures."""
    return batch.column(column) if isinstance(column, str) else pc.struct_field(batch.column(column[0]), [column[1]])


def place_of(docs: DataFrame, column: str) -> int:
    """The position of a column, whose name Spark reads without case."""
    return [c.lower() for c in docs.columns].index(column.lower())


def text_slices(batch: pa.RecordBatch, column="text", text_bytes: int = 4 << 20):
    """Slices of about ``text_bytes`` of a column of texts (see ``text_in``), so memory does not follow a batch's longest texts."""
    size = np.asarray(pc.fill_null(pc.binary_length(text_in(batch, column)), 0))
    cut = np.flatnonzero(np.diff(np.cumsum(size) // text_bytes)) + 1
    edges = [0, *cut.tolist(), len(size)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


# Membership filters --------------------------------------------------------------------

#: 16 bits a key, in at most 2**30 bits: 128 MB however large the key set is, rows of 4 KB.
LEAST_BITS, MOST_BITS = 16, 30


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(1 << bits)) + F.lit(1)


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap over hashed 64-bit keys, sized by their number and bounded by ``MOST_BITS``,
    so it may be broadcast; like a Bloom filter it has false hits but no misses."""
    size = min(MOST_BITS, max(LEAST_BITS, keys.count().bit_length() + 4))
    k = keys.select(_slot(F.col(key), size).alias("s"))
    out = k.groupBy(F.bitmap_bucket_number("s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bits"))
    out._trailspark_bits = size
    return out


def with_membership(df: DataFrame, bits: DataFrame, key: Column, flag: str) -> DataFrame:
    """Add a boolean ``flag``: false only for keys that are surely not in the filter. No row moves."""
    s = _slot(key, bits._trailspark_bits)
    at = F.bitmap_bit_position("_s")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int"))) != 0, F.lit(False))
    return (
        df.withColumn("_s", s).withColumn("_bucket", F.bitmap_bucket_number("_s"))
        .join(F.broadcast(bits), "_bucket", "left")
        .withColumn(flag, hit).drop("_s", "_bucket", "_bits")
    )


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (one column of ids), with all their columns; null equals null.

    A bitmap of bounded size sets apart the rows that may be in it, so that only those are joined and no other row moves.
    """
    gone = materialise(gone.toDF("_gone").distinct(), "gone")
    bits = key_filter(gone.select(F.xxhash64("_gone").alias("k")), "k")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"))
    marked = with_membership(rows, bits, F.xxhash64("_id"), "_maybe")
    kept = marked.where("_maybe").join(gone, F.col("_id").eqNullSafe(F.col("_gone")), "left_anti")
    return marked.where("NOT _maybe").unionByName(kept).select("_row.*")


#: A key is hot where it has more than one row in HOT_SHARE; there are at most HOT_SHARE such keys.
HOT_SHARE, SALTS = 1_000, 64


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, salt: Column, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``keyed`` (one row a key; ``count``: how many of ``rows`` have it), no key in one task.

    Rows of hot keys are dealt by ``salt`` over ``SALTS`` copies of their key's row. The hot keys, at most ``HOT_SHARE``,
    are broadcast.
    """
    total = (keyed.agg(F.sum(count)).first()[0] or 0) if total is None else total
    hot = keyed.where(F.col(count) > total / HOT_SHARE).select(*keys, F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(salt, F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    many = F.when(F.col(count) > total / HOT_SHARE, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(keyed.withColumn("_salt", F.explode(many)), [*keys, "_salt"]).drop("_salt")
