"""Line-run deduplication by a suffix array over line ids, with DataFrame functions only.

Every non-blank line gets a 128-bit id. Lines whose id occurs once end every repeated run, so only the stretches of
repeated lines of each text go on, and of these only such as hold enough words. Prefix doubling ranks them: the rank
of the run of ``2**k`` lines at each position comes from the pair of ranks of its halves, by a range-partitioned sort of
the distinct pairs; runs that occur once drop out. With the ranks of all levels, two suffixes have a longest common prefix of ``n``
lines at least when the ranks of their first and last ``2**k`` lines of these agree (``2**k <= n < 2**(k+1)``), so
suffixes with equal pairs are one interval of the suffix array. The union of a text's qualifying intervals gives its
maximal repeated runs; the first copy of each interval stays and the later ones are deleted.

A repeated run qualifies when it holds at least ``min_words`` words. Every line of a qualifying run
lies in a smallest qualifying run that starts or ends at some line of it, so those two per line
are enough. They have ``min_words`` lines at most, which bounds the levels whatever the texts' length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import WORD_PATTERN, key_filter, materialise, spread_join, with_membership

#: What names a row of the table: a hash of id and text, and the text's length, so that null ids and repeated ids are no case of their own.
ROW = ["_k", "_size"]


def _row(id_col: str, text_col: str) -> list:
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("_k"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("_size")]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, row, _at: the line's number among the non-blank ones, its id a, b and its words)."""
    found = F.expr(f"filter(split(coalesce(`{text_col}`, ''), '\\n', -1), x -> regexp_like(x, r'{WORD_PATTERN}'))")
    rows = docs.select(F.col(id_col).alias("_id"), *_row(id_col, text_col), F.posexplode(found).alias("_at", "_x"))
    return rows.select("_id", *ROW, "_at", F.xxhash64("_x").alias("a"), F.xxhash64(F.lit(1), "_x").alias("b"), F.regexp_count("_x", F.lit(WORD_PATTERN)).cast("long").alias("_words"))


def _ranked(pairs: DataFrame, tag: str) -> DataFrame:
    """Ranks of the pairs (a, b) that occur more than once: a, b, c (how often), r. Ranks grow with the pairs over all
    partitions of the sort, and need not be dense."""
    often = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return materialise(often.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("r", F.monotonically_increasing_id()), tag)


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Positions in stretches of repeated lines with ``min_words`` words at least: _id, row, _run (their stretch), _at, r, _before
    (words of the stretch before the line), _words, _all (words of the stretch), _end (the position behind it)."""
    ranks = _ranked(lines, "ranks0")
    maybe = with_membership(lines, key_filter(ranks.select(F.xxhash64("a", "b").alias("k")), "k"), F.xxhash64("a", "b"), "_maybe").where("_maybe").drop("_maybe")
    at = spread_join(maybe, ranks, ["a", "b"], "c", F.xxhash64("_k", "_at")).select("_id", *ROW, "_at", "_words", "r")
    by_row = Window.partitionBy(*ROW).orderBy("_at")
    # Rows that repeat an id and its text are one.
    at = at.withColumn("_last", F.lag("_at").over(by_row)).where("_last is null or _last < _at").drop("_last")
    at = at.withColumn("_run", F.col("_at") - F.row_number().over(by_row))
    run = Window.partitionBy(*ROW, "_run")
    at = at.withColumn("_before", F.sum("_words").over(run.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_words"))
    at = at.withColumn("_all", F.sum("_words").over(run)).withColumn("_end", F.max("_at").over(run) + 1)
    return materialise(at.where(F.col("_all") >= min_words), "stretches")


def _windows(at: DataFrame, min_words: int) -> DataFrame:
    """Smallest runs of ``min_words`` words that start or end at each line: _id, row, _at, n."""
    # A line's place in words, and one place more behind the last line of a stretch.
    place = F.struct(F.col("_at").alias("p"), F.col("_before").alias("w"))
    behind = F.when(F.col("_at") + 1 == F.col("_end"), F.struct(F.col("_end").alias("p"), F.col("_all").alias("w")))
    places = at.select("_id", *ROW, "_run", F.explode(F.array_compact(F.array(place, behind))).alias("x")).select("_id", *ROW, "_run", F.col("x.p").alias("p"), F.col("x.w").alias("w"))
    run = Window.partitionBy(*ROW, "_run")
    ends = F.min("p").over(run.orderBy(F.col("w").desc()).rangeBetween(Window.unboundedPreceding, -min_words))
    starts = F.max("p").over(run.orderBy("w").rangeBetween(Window.unboundedPreceding, -min_words))
    both = places.withColumn("e", ends).withColumn("s", starts)
    pairs = F.array_compact(F.array(F.when(F.col("e").isNotNull(), F.struct(F.col("p").alias("s"), F.col("e").alias("e"))), F.when(F.col("s").isNotNull(), F.struct("s", F.col("p").alias("e")))))
    out = both.select("_id", *ROW, F.explode(pairs).alias("x")).select("_id", *ROW, F.col("x.s").alias("_at"), (F.col("x.e") - F.col("x.s")).alias("n")).distinct()
    return materialise(out, "windows")


def _levels(at: DataFrame, longest: int) -> DataFrame:
    """Ranks by prefix doubling: row, _at, k, r, for the repeated runs of ``2**k`` lines up to ``longest``."""
    level = at.select(*ROW, "_at", "r")
    out, k = level.withColumn("k", F.lit(0)), 0
    while 1 << (k + 1) <= longest:
        half = Window.partitionBy(*ROW).orderBy("_at").rangeBetween(1 << k, 1 << k)
        pairs = level.withColumnRenamed("r", "a").withColumn("b", F.max("a").over(half)).where("b is not null")
        k += 1
        ranks = _ranked(pairs, f"ranks{k}")
        level = materialise(spread_join(pairs, ranks, ["a", "b"], "c", F.xxhash64("_k", "_at")).select(*ROW, "_at", "r"), f"level{k}")
        out = out.unionByName(level.withColumn("k", F.lit(k)))
    return out


def _repeated(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """Maximal repeated runs to delete: _id, row, first_line, n_lines, _first (id and line of the first copy of their first part)."""
    at = _stretches(materialise(_lines(docs, id_col, text_col), "lines"), max(1, min_words))
    windows = _windows(at, max(1, min_words))
    levels = _levels(at, windows.agg(F.max("n")).first()[0] or 0)
    named = windows.withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int")).withColumn("_tail", F.col("_at") + F.col("n") - F.expr("shiftleft(1, k)"))
    head = levels.withColumnRenamed("r", "a")
    tail = levels.select(*ROW, F.col("_at").alias("_tail"), "k", F.col("r").alias("b"))
    named = materialise(named.join(head, [*ROW, "_at", "k"]).join(tail, [*ROW, "_tail", "k"]).select("_id", *ROW, "_at", "n", "a", "b"), "named")
    intervals = named.groupBy("n", "a", "b").agg(F.min(F.struct("_id", "_at")).alias("_first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    later = spread_join(named, materialise(intervals, "intervals"), ["n", "a", "b"], "c", F.xxhash64("_k", "_at")).where(F.struct("_id", "_at") > F.col("_first"))
    # Gaps and islands within one text: a run begins where no earlier window reaches.
    w = Window.partitionBy(*ROW).orderBy("_at", F.desc("n"), "_first")
    reach = F.max(F.col("_at") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.select("_id", *ROW, "_at", "n", "_first").withColumn("_new", (F.coalesce(reach, F.lit(-1)) < F.col("_at")).cast("int"))
    runs = runs.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*ROW, "_no").agg(
        F.first("_id").alias("_id"), F.min("_at").alias("first_line"), (F.max(F.col("_at") + F.col("n")) - F.min("_at")).alias("n_lines"), F.min(F.struct("_at", "_first")).alias("_m"),
    ).select("_id", *ROW, "first_line", "n_lines", F.col("_m._first").alias("_first"))


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeated runs to delete: id, first_line, n_lines (in non-blank lines), source_id, source_line.

    ``source_*`` is the first copy of the run's first part, in the order of (id, line).
    """
    runs = _repeated(docs, min_words, id_col, text_col)
    return runs.select(F.col("_id").alias(id_col), "first_line", "n_lines", F.col("_first._id").alias("source_id"), F.col("_first._at").alias("source_line"))


def line_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text`` without later copies of repeated line runs, ``n_lines`` and ``n_removed``.

    Lines are split at \\n and compared as they are; runs are counted over non-blank lines, and blank
    lines stay. The first copy, by (id, line), stays; texts with no qualifying run keep every byte.
    Null and empty texts give the empty text and one (blank) line. Rows repeated with the same id and
    text count as one copy; of rows that share an id but not a text, each keeps what no row before it in (id, line) has, and
    copies among them stay where they begin at the same line. A null id compares lowest. An empty table gives
    no rows. Other columns of ``docs`` are ignored, whatever their names. Texts without a deleted line do not move.
    """
    spans = materialise(_repeated(docs, min_words, id_col, text_col).groupBy(*ROW).agg(F.collect_list(F.struct("first_line", "n_lines")).alias("_spans")), "spans")
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *_row(id_col, text_col))
    marked = with_membership(base, key_filter(spans.select(F.xxhash64(*ROW).alias("k")), "k"), F.xxhash64(*ROW), "_maybe")
    lines = F.split("_text", "\n", -1)
    cut = marked.where("_maybe").join(spans, ROW, "left").withColumn("_lines", lines)
    full = F.expr(f"filter(transform(_lines, (x, i) -> if(regexp_like(x, r'{WORD_PATTERN}'), i, null)), i -> i is not null)")
    cut = cut.withColumn("_full", full).withColumn("_gone", F.expr("flatten(transform(coalesce(_spans, array()), s -> slice(_full, s.first_line + 1, s.n_lines)))"))
    # By sets of line numbers: the cost grows with the lines, not with their product.
    left = F.expr("transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> _lines[i])")
    cut = cut.select("_id", F.when(F.size("_gone") == 0, F.col("_text")).otherwise(F.array_join(left, "\n")).alias("_text"), F.size("_lines").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"))
    whole = marked.where("NOT _maybe").select("_id", "_text", F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return whole.unionByName(cut).select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "n_lines", "n_removed")
