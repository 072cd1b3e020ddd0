"""Rollups over enriched, numbered events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions import scalars as S

AGENT_MARKS = (".agents", ".codex", ".claude", ".gemini")


def counts(events: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Non-empty values by count; with ``k`` the most common, ties by first appearance."""
    return _top(events.where(S.text(column) != "").select(F.col(column).alias("value"), F.struct("event_number").alias("at")), k)


def exploded_counts(events: DataFrame, column: str | Column, k: int | None = None) -> DataFrame:
    return _top(events.select("event_number", F.posexplode(column).alias("pos", "value")).select("value", F.struct("event_number", "pos").alias("at")), k)


def _top(rows: DataFrame, k: int | None) -> DataFrame:
    out = rows.groupBy("value").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("_at"))
    return (out.orderBy(F.desc("count"), "_at").limit(k) if k else out).drop("_at")


def event_types(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def agents(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("agent").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def secret_types(events: DataFrame) -> DataFrame:
    return exploded_counts(events, F.transform("secret_findings", lambda s: s["type"]))


def path_rows(events: DataFrame) -> DataFrame:
    return events.select("event_number", F.posexplode("path_records").alias("pos", "r")).select("event_number", "pos", "r.*")


def path_counts(paths: DataFrame, declared: bool, k: int = 100) -> DataFrame:
    rows = paths.where(F.col("observation") == ("declared" if declared else "observed"))
    return _top(rows.select(F.col("path").alias("value"), F.struct("event_number", "pos").alias("at")), k)


def categorized_paths(paths: DataFrame, k: int = 50) -> DataFrame:
    """The most common observed paths of each category: category, path, count."""
    n = paths.where("observation = 'observed'").groupBy("category", "path").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("event_number", "pos")).alias("_at"))
    w = Window.partitionBy("category").orderBy(F.desc("count"), "_at")
    return n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r", "_at")


def interesting_paths(paths: DataFrame, k: int = 100) -> DataFrame:
    out = paths.where("observation = 'observed'").groupBy("path").agg(
        F.min_by("category", F.struct("event_number", "pos")).alias("category"), F.max("interest_score").alias("interest_score"), F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("interest_score"), F.desc("count"), F.lower("path")).limit(k)


def projects(paths: DataFrame, k: int = 50) -> DataFrame:
    """References, distinct paths, counts by category and marks of each project root."""
    rows = paths.where("observation = 'observed' AND project_root <> ''")
    low = F.lower("path")
    main = rows.groupBy("project_root").agg(
        F.count(F.lit(1)).alias("references"), F.count_distinct("path").alias("unique_paths"), F.bool_or(low.contains(".git")).alias("has_git"),
        F.bool_or(S.has_any(low, AGENT_MARKS)).alias("has_agent_workspace"), F.bool_or(low.contains("visualizations")).alias("has_visualizations"))
    by = rows.groupBy("project_root", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("project_root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    return main.join(by, "project_root").orderBy(F.desc("references"), F.lower("project_root")).limit(k)


def token_usage(events: DataFrame) -> DataFrame:
    """Total input and output tokens: cumulative records count their maximum per source, others their sum."""
    digits = lambda c: F.when(S.text(c).rlike(r"^\d+$"), F.col(c).try_cast("long")).otherwise(0)
    rows = events.select((S.text("token_usage_kind") == "cumulative").alias("cum"), S.first_text(S.text("source_file"), S.text("session_key"), F.lit("codex")).alias("key"),
                         digits("input_tokens").alias("i"), digits("output_tokens").alias("o"))
    peak = rows.where("cum").groupBy("key").agg(F.max("i").alias("i"), F.max("o").alias("o")).select("i", "o")
    both = peak.unionByName(rows.where("NOT cum").select("i", "o"))
    return both.agg(F.coalesce(F.sum("i"), F.lit(0)).alias("input"), F.coalesce(F.sum("o"), F.lit(0)).alias("output"))


def totals(events: DataFrame) -> DataFrame:
    """Events, distinct sessions, turns and processes (exact, over all agents), and groups without any of them."""
    ids = ("session_id", "turn_id", "process_id")
    some = lambda c: F.when(S.strip(S.text(c)) != "", F.col(c))
    none = reduce(lambda a, b: a & b, [S.text(c) == "" for c in ids])
    return events.agg(F.count(F.lit(1)).alias("total_events"), F.count_distinct(some("session_id")).alias("sessions"), F.count_distinct(some("turn_id")).alias("turns"),
                      F.count_distinct(some("process_id")).alias("processes"), F.count_distinct(F.when(none, F.col("session_key"))).alias("uncorrelated_groups"))


def analytics(events: DataFrame) -> dict[str, DataFrame]:
    """Every rollup by name; each is small, and only a sink gathers it."""
    p = path_rows(events)
    return {
        "totals": totals(events), "event_types": event_types(events), "agents": agents(events), "models": counts(events, "model_detected"), "tools": counts(events, "tool_name", 30),
        "working_directories": counts(events, "working_directory", 30), "filesystem_paths": path_counts(p, False), "declared_paths": path_counts(p, True), "interesting_paths": interesting_paths(p),
        "categorized_paths": categorized_paths(p), "user_projects": projects(p), "urls": exploded_counts(events, "urls", 100), "domains": exploded_counts(events, "domains", 100),
        "api_endpoints": exploded_counts(events, "api_endpoints", 100), "git_operations": exploded_counts(events, "git_operations"), "secret_findings": secret_types(events), "token_usage": token_usage(events)}
