"""Interactive views over the timeline: filters, traces, activity edges and secret records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions import scalars as S
from trailspark.operators.events import INTERNAL_TYPES

LOW_TYPES = ("RUNTIME", "SESSION", "MODEL / TOKEN", "SESSION METADATA", "DEVELOPER INSTRUCTION", "SYSTEM CONFIGURATION", "ENVIRONMENT CONTEXT")


def timeline(events: DataFrame, search: str = "", event_type: str = "", agent: str = "", show_internal: bool = False) -> DataFrame:
    df = events if show_internal else events.where(~F.col("event_type").isin(*INTERNAL_TYPES))
    df = df.where(F.lower(F.to_json(F.struct("*"))).contains(search.lower())) if search else df
    df = df.where(F.col("event_type") == event_type) if event_type else df
    return df.where(F.col("agent") == agent) if agent else df


def replay_rows(replay: DataFrame, search: str = "", agent: str = "") -> DataFrame:
    df = replay.where(F.lower("message").contains(search.lower())) if search else replay
    return df.where(F.col("agent") == agent) if agent else df


def indicator_rows(iocs: DataFrame, search: str = "", kind: str = "") -> DataFrame:
    df = iocs.where(F.lower(F.to_json(F.struct("*"))).contains(search.lower())) if search else iocs
    return df.where(F.col("type") == kind) if kind else df


def is_low_level() -> Column:
    """Runtime noise of one agent that graphs leave out unless asked."""
    kind, action, source = F.upper(S.text("event_type")), S.text("action"), F.lower(S.text("source_type"))
    noisy = kind.isin(*LOW_TYPES) | action.isin("RuntimeToolEvent", "SQLiteRecord") | (source.startswith("sqlite:") & kind.isin("USER PROMPT", "ASSISTANT RESPONSE"))
    return (F.lower(S.text("agent")) == "codex") & (kind != "WARNING / ERROR") & noisy


def graph_events(events: DataFrame, low_level: bool = False, internal: bool = True, agent: str = "", session: str = "") -> DataFrame:
    df = events.where(~((F.lower(S.text("agent")) == "codex") & (F.lower(S.text("tool_name")) == "exec")))
    df = df if low_level else df.where(~is_low_level())
    df = df if internal else df.where(~F.col("event_type").isin(*INTERNAL_TYPES))
    df = df.where(F.col("agent") == agent) if agent else df
    return df.where(lane() == session) if session else df


def lane() -> Column:
    return S.first_text(S.text("session_key"), S.text("session_id"), S.text("correlation_key"), F.lit("uncorrelated"))


def kind() -> Column:
    t, a = F.upper(S.text("event_type")), F.lower(S.text("action"))
    return (F.when(t == "USER PROMPT", "user").when(t == "ASSISTANT RESPONSE", "assistant").when(t.contains("COMMAND") | a.contains("exec") | (a == "run_command") | (S.text("tool_name") != ""), "tool")
            .when((S.text("target") != "") | a.contains("file") | a.contains("directory"), "file").otherwise("other"))


def preview() -> Column:
    spaced = lambda *cols: F.replace(S.first_text(*cols), F.lit("_"), F.lit(" "))
    t = S.text
    base = S.first_text(S.display_basename(t("target")), t("target"))
    tool, command = spaced(t("tool_name"), t("action"), F.lit("Tool activity")), F.get("commands", F.lit(0))
    file = spaced(t("action"), F.lit("File activity"))
    arrow = lambda head: F.concat(head, F.lit(" → "), base)
    return (
        F.when(kind().isin("user", "assistant"), S.collapse(S.first_text(t("text"), t("summary"), t("details"), t("event_type"))))
        .when(kind() == "tool", F.when(S.text(command) != "", F.concat(tool, F.lit(": "), command)).when(base != "", arrow(tool)).otherwise(tool))
        .when(kind() == "file", F.when(t("target") != "", arrow(file)).otherwise(file))
        .otherwise(S.collapse(S.first_text(t("summary"), t("action"), t("event_type"), F.lit("Event")))))


def badge() -> Column:
    return (F.when(kind() == "user", "User prompt").when(kind() == "assistant", "Assistant reply")
            .when(kind() == "tool", F.when(S.text("tool_name") != "", F.replace("tool_name", F.lit("_"), F.lit(" "))).otherwise("Tool / command"))
            .when(kind() == "file", "File activity").otherwise(F.replace(S.first_text(S.text("event_type"), F.lit("Evidence")), F.lit("_"), F.lit(" "))))


def risks() -> Column:
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    flags = [("Secret", some("secret_findings")), ("Network", some("urls") | some("domains") | F.lower(S.text("event_type")).contains("network")), ("Command", some("commands") | (kind() == "tool")),
             ("File", (S.text("target") != "") | (kind() == "file")), ("Error", F.concat_ws(" ", S.text("level"), S.text("summary")).rlike("(?i)error|fail|denied"))]
    return F.array_compact(F.array(*[F.when(c, n) for n, c in flags]))


def trace_blocks(events: DataFrame, key: str = "session_key", order: str = "event_number", anchor: Column | None = None) -> DataFrame:
    """Adds ``block``: the running number of user and assistant anchors of a session; 0 before the first."""
    hit = kind().isin("user", "assistant") if anchor is None else anchor
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("block", F.sum(hit.cast("long")).over(w))


def edges(events: DataFrame, key: str = "session_key", order: str = "event_number") -> DataFrame:
    """Consecutive events of a session: key, source, target, kind (of the target)."""
    w = Window.partitionBy(key).orderBy(order)
    return events.select(F.col(key), F.lag(order).over(w).alias("source"), F.col(order).alias("target"), kind().alias("kind")).where("source is not null")


def sessions(events: DataFrame) -> DataFrame:
    """One row per lane in order of appearance: events, first event and title."""
    df = events.withColumn("lane", lane()).withColumn("_k", kind()).withColumn("_p", preview())
    pick = F.struct((F.col("_k") != "user").alias("a"), F.col("event_number").alias("b"))
    out = df.groupBy("lane").agg(F.count(F.lit(1)).alias("events"), F.min("event_number").alias("first_event"), F.min_by(F.struct("timestamp_utc", "agent", "_p"), pick).alias("f"))
    title = F.concat(F.left(S.first_text(S.text("f.timestamp_utc"), F.lit("Date unavailable")), F.lit(10)), F.lit(" · "), S.first_text(S.text("f.agent"), F.lit("unknown agent")), F.lit(" · "),
                     S.first_text(F.left("f._p", F.lit(72)), F.lit("Session activity")))
    return out.select("lane", "events", "first_event", title.alias("title"))


def secret_records(events: DataFrame) -> DataFrame:
    """One row per (type, masked value): hash, scope, category, the content event that stands for it, events, agents.

    With several content events the last one stands for the finding, else the first event.
    """
    content = F.upper(S.text("event_type")).isin("USER PROMPT", "ASSISTANT RESPONSE") | F.coalesce("conversation_eligible", F.lit(False))
    cookie = F.concat_ws(" ", S.text("summary"), S.text("details")).rlike("(?i)set-cookie|cookie")
    f = events.select("event_number", "timestamp_utc", "agent", content.alias("content"), cookie.alias("cookie"), F.posexplode("secret_findings").alias("pos", "f"))
    f = f.select("*", S.first_text(F.col("f.type"), F.lit("Potential secret")).alias("type"), S.first_text(F.col("f.masked"), F.lit("[REDACTED]")).alias("masked"), F.nullif("f.sha256", F.lit("")).alias("sha256"))
    g = f.groupBy("type", "masked").agg(
        F.coalesce(F.min_by("sha256", F.when(F.col("sha256").isNotNull(), F.struct("event_number", "pos"))), F.lit("")).alias("sha256"), F.bool_or("content").alias("_c"), F.bool_or(~F.col("content") & F.col("cookie")).alias("_k"),
        F.max(F.when(F.col("content"), F.col("event_number"))).alias("_last"), F.min("event_number").alias("_first"), F.array_sort(F.collect_set("event_number")).alias("events"), F.array_sort(F.collect_set("agent")).alias("agents"))
    return g.select("type", "masked", "sha256", F.when(F.col("_c"), "content").otherwise("runtime").alias("scope"),
                    F.when(F.col("_c"), "User/content exposure").when(F.col("_k"), "Infrastructure/session cookie").otherwise("Agent/runtime credential").alias("category"),
                    F.coalesce("_last", "_first").alias("shown_event"), "events", "agents")
