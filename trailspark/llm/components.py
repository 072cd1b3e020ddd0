"""Connected components by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import drop_table, materialise, spread_join


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) to (id, component) for every node with an edge to another; component is the smallest
    node reachable. No list of neighbours is ever gathered: minima are aggregates, and joins carry edges."""
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = materialise(pairs, "edges")
    state = _state(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("c")).where("c > 0").select("u", F.least("u", "m").alias("m"), "c")
        # A star's centre may have a third of all edges.
        starred = spread_join(both.where("v > u"), least, ["u"], "c", F.xxhash64("v"), state["n"])
        large = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        small = spread_join(large, down, ["u"], "c", F.xxhash64("v"), state["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialise(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(nxt)
        drop_table(cur)
        cur = nxt
        if before == state:
            break
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
