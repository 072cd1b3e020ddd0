"""MinHash near-duplicates with sequential Bayesian verification.

Texts with the same shingle set are one class. Classes that share a band's bucket, directly or through
others, form a candidate cluster, so each class is compared in one place only. Inside a cluster, pairs that share a
bucket and are not yet connected are compared batch by batch of their signatures: under a uniform prior the
posterior of the similarity after m of n agreements is Beta(m + 1, n - m + 1), and the pair is dropped once the
chance of reaching the threshold falls below ``miss``. Survivors are confirmed on their full shingle sets, and
a cluster gives back a spanning forest of confirmed links, never all its pairs. A cluster of
more than ``BLOCK`` classes is cut into blocks, one task per two blocks, so no task holds more than two. Bands
are so many that a pair at the threshold misses all of them with probability ``miss`` at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm import shingles as S
from trailspark.llm.common import drop_worker_state, key_filter, materialise, spread_join, text_slices, with_membership, without_ids
from trailspark.llm.components import components

ROWS_PER_BAND, BATCH = 5, 20
#: Classes of a cluster that one comparison task holds on each side.
BLOCK = 1_000


def bands_for(percent: int, miss: float, rows: int = ROWS_PER_BAND) -> int:
    """Bands with which a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def bayes_bounds(percent: int, miss: float, total: int, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, least agreements) after each batch: with fewer, P(similarity >= threshold) is below ``miss``.

    With a uniform prior that probability is P(Binomial(n + 1, threshold) <= m).
    """
    t, out = percent / 100, []
    for n in [*range(batch, total, batch), total]:
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _agree(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices survive every batch."""
    alive, m, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in bounds:
        m = m + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        keep = m >= least
        alive, m, done = alive[keep], m[keep], n
    return alive


def _signed(docs: DataFrame, perms: int, words: int) -> DataFrame:
    def run(batches):
        drop_worker_state()
        a, b = S.permutations(perms)
        for big in batches:
            for batch in text_slices(big):
                sets = [S.shingle_set(t, words) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([S.digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([S.signature(s, a, b).tobytes() if len(s) else None for s in sets], pa.binary())], ["id", "n", "cls", "sig"])

    return docs.mapInArrow(run, "id long, n long, cls binary, sig binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, cls, s): the full shingle sets of texts."""

    def run(batches):
        drop_worker_state()
        for big in batches:
            for batch in text_slices(big):
                sets = [S.shingle_set(t, words) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([S.digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "cls", "s"])

    return docs.mapInArrow(run, "id long, cls binary, s binary")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        a, b = sorted((self.find(i), self.find(j)))
        self.root[b] = a
        return a != b

    def roots(self) -> np.ndarray:
        while (self.root != self.root[self.root]).any():
            self.root = self.root[self.root]
        return self.root


def confirm(sigs: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int, bounds) -> list[tuple[int, int]]:
    """Spanning links among the members of one task. ``sides``: with two values, only pairs across them count."""
    n, links, forest = len(sets), [], Forest(len(sets))
    # Buckets: the members of each band by its value.
    bands = np.ascontiguousarray(sigs.reshape(n, -1, ROWS_PER_BAND)).view(f"V{4 * ROWS_PER_BAND}")[..., 0].T
    coded = [np.unique(band, return_inverse=True)[1] for band in bands]
    by_code = [np.argsort(code, kind="stable") for code in coded]
    first = [np.searchsorted(code[at], np.arange(code.max() + 2)) for code, at in zip(coded, by_code)]
    size = np.array([len(s) for s in sets])
    across = len(set(sides.tolist())) > 1
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    values, owners = flat[order], owner[order]
    for i in range(n - 1):
        apart = (forest.roots() != forest.find(i)) & ((sides != sides[i]) | (not across))
        apart[: i + 1] = False
        if not apart.any():
            continue
        shared = np.zeros(n, bool)
        for code, at, begin in zip(coded, by_code, first):
            shared[at[begin[code[i]] : begin[code[i] + 1]]] = True
        other = np.flatnonzero(shared & apart)
        lo, hi = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
        other = other[100 * lo >= percent * hi]
        if len(other):
            other = other[_agree(np.broadcast_to(sigs[i], (len(other), sigs.shape[1])), sigs[other], bounds)]
        if not len(other):
            continue
        if len(other) < 8:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in other])
        else:  # overlaps with every member at once, from the lists of who holds each shingle
            start, end = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            held = np.concatenate([owners[a:b] for a, b in zip(start, end)])
            common = np.bincount(held, minlength=n)[other]
        for j in other[100 * common >= percent * (size[other] + size[i] - common)].tolist():
            if forest.join(i, j):
                links.append((i, j))
    return links


def _compare(rows: DataFrame, percent: int, bounds) -> DataFrame:
    """Links of rows (task, side, id, sig, s) that lie together by task."""

    def settle(held: list) -> pa.RecordBatch:
        _, side, ids, sig, sets = zip(*held)
        links = confirm(np.frombuffer(b"".join(sig), np.uint32).reshape(len(ids), -1), [np.frombuffer(x, np.uint64) for x in sets], np.array(side), percent, bounds)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in links], pa.int64()), pa.array([ids[j] for _, j in links], pa.int64())], ["u", "v"])

    def run(batches):
        drop_worker_state()
        held: list = []
        for big in batches:
            for batch in text_slices(big, "s"):
                for row in zip(*(batch.column(c).to_pylist() for c in ("task", "side", "id", "sig", "s"))):
                    if held and held[-1][0] != row[0]:
                        yield settle(held)
                        held = []
                    held.append(row)
        if held:
            yield settle(held)

    return rows.select("task", "side", "id", "sig", "s").repartition("task").sortWithinPartitions("task", "id").mapInArrow(run, "u long, v long")


def _members(clusters: DataFrame) -> DataFrame:
    """(id, task, side): a small cluster is one task; of a larger one each member meets every block once."""
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    cut = clusters.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.struct("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    return cut.select("id", F.xxhash64(pair).alias("task"), F.when(F.col("mine") == F.greatest("mine", "other"), 1).otherwise(0).alias("side"))


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = S.WORDS, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Rows with equal shingle sets, or whose sets share at least ``percent`` % of their union, are linked; a
    component is named by the smallest id reachable, and that row is kept. Null texts and texts without words have
    no shingles and are linked with nothing. Rows that repeat an id are one document for links.
    Rows with a null id have no component to be named by (null), are linked with nothing and kept. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    bands = bands_for(percent, miss)
    perms = bands * ROWS_PER_BAND
    bounds = bayes_bounds(percent, miss, perms)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialise(_signed(texts, perms, words), "signed")
    classes = materialise(signed.where("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("rows")), "classes")
    width = 4 * ROWS_PER_BAND
    keyed = classes.select("id", F.explode(F.expr(f"transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(sig, i * {width} + 1, {width})))")).alias("key"))
    heads = keyed.groupBy("key").agg(F.min("id").alias("u"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "u")
    clusters = materialise(components(keyed.join(heads, "key").select("u", F.col("id").alias("v"))), "clusters")
    wanted = with_membership(texts, key_filter(clusters.select(F.xxhash64("id").alias("k")), "k"), F.xxhash64("id"), "_hit").where("_hit").select("id", "text")
    full = _sets(wanted, words).join(_members(clusters), "id").join(classes.select("id", "sig", "cls"), ["id", "cls"])
    links = materialise(_compare(full, percent, bounds), "links")
    labels = materialise(components(links), "labels")
    reps = classes.join(labels, "id", "left").select("cls", F.coalesce("component", "id").alias("component"), "rows")
    # Most classes have one row, whose component is their own or that of its label; large ones are dealt over many tasks.
    out = spread_join(signed.where("cls is not null and id is not null").select("id", "n", "cls"), materialise(reps, "reps"), ["cls"], "rows", F.xxhash64("id")).select("id", "n", "component")
    bare = signed.where("cls is null or id is null").select("id", "n", F.col("id").alias("component"))
    return out.unionByName(bare).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; of rows that repeat an id and text, each."""
    return without_ids(docs, near_duplicates(docs, id_col=id_col, **options).where("NOT kept").select(id_col), id_col)
