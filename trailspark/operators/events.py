"""The event model: schema, classification, keys and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspark.functions import json_walk
from trailspark.functions import patterns as P
from trailspark.functions import scalars as S
from trailspark.operators import extract, network, paths

FIELDS = (
    "timestamp_utc agent category action text details username hostname session_id turn_id call_id process_id tool_name model working_directory target level source_type source_file "
    "source_line evidence_hash").split()
#: Typed sidecars of the metadata that operators read, so that none has to parse it again.
SIDECARS = "record_type role conversation_eligible token_usage_kind".split()
SCHEMA = T.StructType(
    [T.StructField(f, T.StringType()) for f in FIELDS]
    + [T.StructField("metadata", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("role", T.StringType()),
       T.StructField("conversation_eligible", T.BooleanType()), T.StructField("token_usage_kind", T.StringType()), T.StructField("ingest_ord", T.StringType())])
INTERNAL_TYPES = ("SYSTEM CONFIGURATION", "DEVELOPER INSTRUCTION", "ENVIRONMENT CONTEXT", "SESSION METADATA")
FREE_PATH_TYPES = ("USER PROMPT", "COMMAND", "FILE READ", "FILE CHANGE", "GIT", "TOOL", "MCP", "PLUGIN / SKILL")
#: Metadata lookups of enrichment and indicators, by name.
LOOKUPS = {
    "model": ("model_name", "model_id"), "input_tokens": ("input_tokens", "prompt_tokens"), "output_tokens": ("output_tokens", "completion_tokens"),
    "reasoning": ("reasoning_effort", "reasoning"), **{f"cmd:{k}": (k,) for k in ("command", "cmd", "argv", "process_command_line")},
    **{f"url:{k}": (k,) for k in P.URL_KEYS}, **{f"host:{k}": (k,) for k in P.HOST_KEYS},
}


def conform(df: DataFrame) -> DataFrame:
    """``df`` in the event schema: missing fields get their defaults, others are dropped."""
    have = set(df.columns)
    default = {"agent": "generic", "category": "Runtime"}
    cols = []
    for f in SCHEMA:
        if f.name in have:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.dataType == T.BooleanType():
            cols.append(F.lit(False).alias(f.name))
        elif f.name == "metadata":
            cols.append(F.lit(None).cast("string").alias(f.name))
        else:
            cols.append(F.lit(default.get(f.name, "")).alias(f.name))
    return df.select(*cols)


def classify() -> Column:
    """The event type: the first rule that holds."""
    category, action, tool = F.trim(S.text("category")), F.lower(S.text("action")), F.lower(S.text("tool_name"))
    kind, role, level = F.lower(S.text("record_type")), F.lower(S.text("role")), F.lower(S.text("level"))
    words = F.concat_ws(" ", F.lower(category), action, kind, tool)
    has = lambda *w: S.has_any(words, w)
    context = F.regexp_replace(S.text("text"), r"(?U)^\s+", "").startswith("<environment_context>")
    return (
        F.when(category == "Prompt", F.when(context, "ENVIRONMENT CONTEXT").otherwise("USER PROMPT"))
        .when(category == "AssistantMessage", "ASSISTANT RESPONSE")
        .when(role == "developer", "DEVELOPER INSTRUCTION").when(role == "system", "SYSTEM CONFIGURATION").when(kind == "session_meta", "SESSION METADATA")
        .when(has("approval", "request_permissions"), "APPROVAL")
        .when(has("apply_patch", "write_file", "edit_file", "file_write"), "FILE CHANGE")
        .when(has("read_file", "open_file", "view_file", "file_read"), "FILE READ")
        .when(has("exec_command", "shell_command", "commandevent", "powershell", "cmd.exe"), "COMMAND")
        .when(tool.contains("git") | action.startswith("git"), "GIT")
        .when(has("mcp"), "MCP").when(has("plugin", "skill"), "PLUGIN / SKILL")
        .when(has("network", "http", "sse", "websocket", "dns"), "NETWORK / API")
        .when((S.text("model") != "") | has("token_usage", "input_tokens", "output_tokens"), "MODEL / TOKEN")
        .when(level.isin("error", "warn", "warning", "fatal"), "WARNING / ERROR")
        .when(category == "ExternalTelemetry", "EXTERNAL TELEMETRY")
        .when((S.text("tool_name") != "") | (category == "ToolOrAction"), "TOOL")
        .when(category == "SessionOrTurn", "SESSION").otherwise("RUNTIME"))


def session_key() -> Column:
    key = lambda kind, v: F.concat(S.text("agent"), F.lit(f":{kind}:"), v)
    has = lambda c: S.text(c) != ""
    return (
        F.when(has("session_id"), key("session", F.col("session_id"))).when(has("turn_id"), key("turn", F.col("turn_id"))).when(has("process_id"), key("process", F.col("process_id")))
        .when(has("source_file"), key("file", S.basename(F.col("source_file")))).otherwise(key("uncorrelated", S.first_text(S.text("username"), F.lit("unknown")))))


def correlation_key() -> Column:
    return S.first_text(*[S.text(c) for c in ("call_id", "turn_id", "session_id", "process_id")])


def summary(limit: int = 300) -> Column:
    s = S.collapse(S.first_text(*[S.text(c) for c in ("text", "details", "target", "action", "event_type")]))
    return S.let(s, lambda x: F.when(F.char_length(x) > limit, F.concat(F.left(x, F.lit(limit)), F.lit("…"))).otherwise(x))


def enrich(events: DataFrame) -> DataFrame:
    """All derived columns of an event, row by row. One Arrow pass looks metadata up; the rest are expressions."""
    df = events.withColumn("agent", F.when(S.text("agent").isin("", "generic"), "codex").otherwise(F.col("agent")))
    df = df.withColumn("event_type", classify()).withColumn("session_key", session_key()).withColumn("correlation_key", correlation_key()).withColumn("summary", summary())
    df = df.withColumn("meta", json_walk.lookups(F.col("metadata"), LOOKUPS)).withColumn("_s", S.searchable_text())
    look = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    df = df.withColumn("paths", F.slice(paths.extract_paths(F.col("_s"), F.col("working_directory"), F.col("target"), F.col("event_type").isin(*FREE_PATH_TYPES)), 1, 100))
    observed = F.when(F.col("event_type").isin(*INTERNAL_TYPES), "declared").otherwise("observed")
    df = df.withColumn("path_records", paths.records(F.col("paths"), observed))
    df = df.withColumn("_u", network.text_urls(F.col("_s"))).withColumn("urls", F.expr("array_distinct(transform(_u, x -> x.url))"))
    df = df.withColumn("domains", network.url_domains(F.col("_u"))).withColumn("api_endpoints", network.url_endpoints(F.col("_u")))
    df = df.withColumn("commands", extract.commands(look)).withColumn("git_operations", F.transform(extract.matches(F.col("_s"), P.GIT, ((), ("git",)), 1), F.lower))
    df = df.withColumn("model_detected", S.first_text(S.clean_model_id(F.col("model")), S.clean_model_id(look("model"))))
    for c in ("input_tokens", "output_tokens", "reasoning"):
        df = df.withColumn(c, look(c))
    return df.withColumn("secret_findings", extract.secret_findings(F.col("_s"))).drop("_s", "_u")
