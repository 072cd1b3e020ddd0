"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree.

Every document of a source wants the same fractional number of copies (target / source size). The whole
part is given; of the fractional parts, two documents at a time compete: word mass moves from one to the
other in a random direction until one of them is integral, with odds that keep each document's
expectation. Moves keep the words of the pair, so a block ends with its exact share of words and one
undecided document. Undecided documents of ``FAN_IN`` blocks meet on the next level of the tree, until one
per source is left and rounded to the nearer side: a source misses its target by half a document at most. Large documents
meet first on every level, so the one that is left is mostly small.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import drop_worker_state, materialise, word_count

#: Rows of a source that one task rounds at level 0, and blocks that meet on each further level.
BLOCK_ROWS, FAN_IN = 2_000, 16
EPS = 1e-9


def fill_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1, 2, 3), max_copies: float = 3.0) -> dict:
    """Targets by source: all sizes shared by weight, no target above ``max_copies`` times its source.

    Sources come in code point order, null last; weights repeat along them. What a capped source
    cannot take is shared again among the others by weight until none is above its cap. Sources
    without words get 0.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    total = float(sum(n for _, n in order))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size, out, left = dict(order), {}, total
    open_ = [s for s, _ in order]
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * each > max_copies * size[s]]
        if not over:
            out |= {s: weight[s] * each for s in open_}
            break
        for s in over:
            out[s] = max_copies * size[s]
            left -= out[s]
            open_.remove(s)
    return out


def pivot(size: np.ndarray, p: np.ndarray, draws: Iterable[float]) -> np.ndarray:
    """Sequential pivotal rounding of one block; keeps sum(size * p); at most one value stays fractional."""
    p, holder = p.copy(), -1
    for i, u in enumerate(draws):
        if not EPS < p[i] < 1 - EPS:
            p[i] = round(p[i])
            continue
        if holder < 0:
            holder = i
            continue
        a, b = holder, i
        up = min(size[a] * (1 - p[a]), size[b] * p[b])
        down = min(size[a] * p[a], size[b] * (1 - p[b]))
        move = up if u * (up + down) < down else -down
        p[a] += move / size[a]
        p[b] -= move / size[b]
        holder = -1
        for j in (a, b):
            if EPS < p[j] < 1 - EPS:
                holder = j
            else:
                p[j] = round(p[j])
    return p


def _level(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        drop_worker_state()
        pdf = pdf.sort_values(["_size", "_h", "_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.Generator(np.random.PCG64([seed, *(pdf["_h"].to_numpy(np.int64)[[0, -1]].astype(np.uint64).tolist()), len(pdf)]))
        p = pivot(pdf["_size"].to_numpy(np.float64), pdf["_p"].to_numpy(np.float64), rng.random(len(pdf)))
        open_ = (p > EPS) & (p < 1 - EPS)
        pdf["_copies"] = pdf["_copies"] + np.where(open_, 0, np.rint(p)).astype(np.int64)
        pdf["_p"] = np.where(open_, p, 0.0)
        return pdf

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: float = 3.0, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, _source, _crc (of the text).

    size counts words (null text: 0). Texts without words have no mass to move: each is rounded by its
    own draw, from its hash. A null source is a source of its own. Repeated rows are
    mixed one by one. The same table gives the same copies whatever its partitioning: order and
    draws come from hashes of the rows. An empty table gives no rows. What the driver collects is one
    row a source: the mixture's definition, not the data.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"),
                       F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_crc"))
    rows = materialise(rows.withColumn("_h", F.xxhash64(F.lit(seed), "_id", "_crc", "_size")), "sizes")
    stats = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    target = fill_targets([(r["_source"], r["size"]) for r in stats], weights, max_copies)
    plan = [(r["_source"], int(r["size"]), float(target[r["_source"]]), min(max_copies, target[r["_source"]] / r["size"]) if r["size"] else 0.0,
             max(1, -(-r["n"] // BLOCK_ROWS))) for r in stats]
    small = spark.createDataFrame(plan, "_s string, _source_size bigint, _target double, _rate double, _blocks bigint")
    small = F.broadcast(small) if len(plan) <= 10_000 else small
    work = rows.join(small, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.floor("_rate")
    block = F.floor(F.shiftrightunsigned("_h", 32) * F.col("_blocks") / F.lit(float(1 << 32))).cast("long")
    own_draw = F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    work = work.withColumn("_block", block).withColumn("_copies", whole.cast("long")).withColumn("_p", F.col("_rate") - whole)
    alone = work.where("_size = 0").withColumn("_copies", F.col("_copies") + (own_draw < F.col("_p")).cast("long")).withColumn("_p", F.lit(0.0))
    level, done = work.where("_size > 0"), [alone]
    for depth in range(64):
        level = materialise(level.groupBy("_source", "_block").applyInPandas(_level(seed + depth), level.schema), f"level{depth}")
        done.append(level.where("_p = 0"))
        level = level.where("_p > 0").withColumn("_block", F.floor(F.col("_block") / FAN_IN).cast("long"))
        if max([p[4] for p in plan], default=1) <= FAN_IN**depth:
            break
    done.append(level.withColumn("_copies", F.col("_copies") + (F.col("_p") >= 0.5).cast("long")).withColumn("_p", F.lit(0.0)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                      F.col("_target").alias("target"), F.col("_copies").alias("copies"), "_source", "_crc")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    # One key for every row, nulls too. Rows that share it are equal in all that counts, and the mix takes them the least number
    # of times or once more: the first ones take the extra copies. Window and join use one shuffle.
    key = lambda source, crc, size: F.xxhash64(F.col(id_col), F.col(source), crc, size).alias("_k")
    taken = mix(docs, **options).groupBy(key("_source", F.col("_crc"), F.col("size"))).agg(
        F.min("copies").alias("_least"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("_extra")).where("_least + _extra > 0")
    crc, size = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), word_count(F.col(text_col))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), key(options.get("source_col", "source"), crc, size))
    both = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_k").orderBy(F.lit(0)))).join(taken, "_k")
    copies = (F.col("_least") + (F.col("_nth") <= F.col("_extra")).cast("long")).alias("_copies")
    return both.select("_row", copies).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")
