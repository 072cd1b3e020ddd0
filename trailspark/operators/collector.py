"""Operators of the acquisition side: profiles, artifact types, log categories and collector rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import patterns as P
from trailspark.functions import scalars as S

SYSTEM_PROFILES = ("all users", "default", "default user", "public", "defaultuser0", "wdagutilityaccount")
TIMELINE = "TimestampUtc Agent Username ProfilePath Source Category Action ThreadId TurnId CallId ToolName WorkingDirectory Level Target Text Details SourceFile LineNumber ProcessUuid".split()
#: Home folders of each agent, relative to a profile.
AGENT_ROOTS = {
    "codex": [".codex"], "claude": [".claude"], "gemini": [".gemini"],
    "cursor": [".cursor", "AppData/Roaming/Cursor", "Library/Application Support/Cursor", ".config/Cursor"],
    "windsurf": [".windsurf", "AppData/Roaming/Windsurf", "Library/Application Support/Windsurf", ".config/Windsurf"],
    "continue": [".continue"], "aider": [".aider.conf.yml", ".aider.chat.history.md", ".aider.input.history"],
}


def log_category(target: Column, body: Column, level: Column) -> Column:
    """Category of a runtime log row; the level decides first, then the patterns in order, without case."""
    both = F.concat(S.text(target), F.lit("\n"), S.text(body))
    out = F.when(S.text(level).rlike("(?i)^(ERROR|WARN)$"), "ErrorOrWarning")
    for name, pattern in P.LOG_CATEGORIES:
        out = out.when(both.rlike(f"(?i){pattern}"), name)
    return out.otherwise("Other")


def log_action(category: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in P.LOG_ACTIONS.items() for x in kv]), category), F.lit("LogEvent"))


def is_generated_context(c: Column) -> Column:
    s = S.strip(S.text(c))
    return (s == "") | s.startswith("<")


def artifact_type(path: Column) -> Column:
    gemini = r"/\.gemini/antigravity-cli/brain/"
    return (F.when(path.rlike(r"/\.codex/sessions/.*\.jsonl$"), "CodexSessionJsonl").when(path.rlike(r"(?s)/\.codex/.*\.(sqlite|sqlite3|db)$"), "CodexRuntimeSqlite").when(path.rlike(r"/\.codex/.*-wal$"), "CodexSqliteWal")
            .when(path.rlike(r"/\.codex/.*-shm$"), "CodexSqliteShm").when(path.rlike(r"/\.codex/session_index\.jsonl$"), "CodexSessionIndex")
            .when(path.rlike(gemini + r".*/\.system_generated/logs/transcript_full\.jsonl$") | path.rlike(gemini + r".*/transcript\.jsonl$"), "GeminiAntigravityTranscriptJsonl").otherwise("AIAgentArtifact"))


def windows_profiles(paths: DataFrame, col: str = "path") -> DataFrame:
    """Profiles under C:\\Users that hold an agent folder, without the six system profiles."""
    part = lambda i: F.regexp_extract(F.col(col), r"(?i)^([A-Z]:\\Users\\([^\\]+))\\\.(?:codex|gemini)(?:\\|$)", i)
    return paths.select(part(1).alias("profile"), part(2).alias("username")).where((F.col("profile") != "") & ~F.lower("username").isin(*SYSTEM_PROFILES)).distinct()


def mac_profiles(paths: DataFrame, col: str = "path", all_users: bool = True, home: str | None = None) -> DataFrame:
    """Profiles under /Users that hold an agent folder, without shared ones; or one given home."""
    if not all_users or home:
        return paths.sparkSession.createDataFrame([(home.rstrip("/"), home.rstrip("/").rsplit("/", 1)[-1])], "profile string, username string")
    part = lambda i: F.regexp_extract(F.col(col), r"^(/Users/([^/]+))/\.(?:codex|gemini)(?:/|$)", i)
    return paths.select(part(1).alias("profile"), part(2).alias("username")).where((F.col("profile") != "") & ~F.col("username").isin("Shared", "Guest", ".localized")).distinct()


def mac_artifacts(path: Column) -> Column:
    """What the macOS collector copies of a profile."""
    return (path.rlike(r"/\.codex/sessions/.*\.jsonl$") | path.rlike(r"/\.codex/[^/]*(?:\.sqlite|\.sqlite3|\.db|\.sqlite-wal|\.sqlite-shm|\.db-wal|\.db-shm)$|/\.codex/session_index\.jsonl$")
            | path.rlike(r"/\.gemini/antigravity-cli/brain/(?:.*/)?transcript(?:_full)?\.jsonl$"))


def timeline_rows(df: DataFrame) -> DataFrame:
    """The 19 collector columns as text: missing ones empty, a blank agent unknown, long texts cut."""
    have = set(df.columns)
    cell = lambda c: S.text(c) if c in have else F.lit("")
    cols = []
    for c in TIMELINE:
        v = S.truncate(cell(c)) if c in ("Text", "Details") else cell(c)
        cols.append((F.when(S.strip(v) == "", "unknown").otherwise(v) if c == "Agent" else v).alias(c))
    return df.select(*cols)


def sorted_rows(df: DataFrame) -> DataFrame:
    return df.orderBy(*[c for c in ("TimestampUtc", "Username", "SourceFile", "LineNumber") if c in df.columns])


def log_rows(logs: DataFrame) -> DataFrame:
    """Collector rows of the fixed runtime table, in its order."""
    category = log_category(F.col("target"), F.col("feedback_log_body"), F.col("level"))
    details = F.concat(F.lit("module="), S.text("module_path"), F.lit("; source="), S.text("file"), F.lit(":"), S.text("line"), F.lit("; log_id="), S.text("id"), F.lit("; estimated_bytes="), S.text("estimated_bytes"))
    return timeline_rows(logs.orderBy("ts", "ts_nanos", "id").select(
        S.unix_time(F.col("ts"), F.col("ts_nanos")).alias("TimestampUtc"), F.lit("codex").alias("Agent"), F.lit("RuntimeSqlite").alias("Source"), category.alias("Category"), log_action(category).alias("Action"),
        S.text("thread_id").alias("ThreadId"), S.text("level").alias("Level"), S.text("target").alias("Target"), S.text("feedback_log_body").alias("Text"), details.alias("Details"), S.text("process_uuid").alias("ProcessUuid")))


def codex_routes(lines: DataFrame) -> dict[str, DataFrame]:
    """Session lines (source_file, source_line, line) by route: prompts, assistant, tools, errors."""
    df = lines.withColumn("v", F.try_parse_json("line")).withColumn("p", F.expr("try_variant_get(v, '$.payload', 'variant')"))
    s = lambda path, root="v": F.coalesce(F.expr(f"try_variant_get({root}, '$.{path}', 'string')"), F.lit(""))
    base = df.where("p is not null").select("source_file", "source_line", s("timestamp").alias("TimestampUtc"), s("type").alias("record"), s("type", "p").alias("kind"), s("role", "p").alias("role"), s("thread_id", "p").alias("ThreadId"),
                                            s("internal_chat_message_metadata_passthrough.turn_id", "p").alias("TurnId"), s("call_id", "p").alias("CallId"), s("name", "p").alias("ToolName"), s("cwd", "p").alias("WorkingDirectory"),
                                            F.expr("from_json(to_json(try_variant_get(p, '$.content', 'variant')), 'array<struct<type string, text string>>')").alias("content"), F.expr("to_json(p)").alias("Details"))
    message = (F.col("record") == "response_item") & (F.col("kind") == "message")
    parts = lambda kind: F.filter("content", lambda c: c["type"] == kind)
    asked = F.array_join(F.transform(F.filter(parts("input_text"), lambda c: ~is_generated_context(c["text"])), lambda c: S.strip(c["text"])), "\r\n")
    said = F.array_join(F.transform(F.filter(parts("output_text"), lambda c: S.strip(S.text(c["text"])) != ""), lambda c: S.strip(c["text"])), "\r\n")
    user, assistant = message & (F.col("role") == "user"), message & (F.col("role") == "assistant")
    return {
        "prompts": base.where(user).withColumn("Text", S.truncate(asked)).where("Text <> ''"), "assistant": base.where(assistant).withColumn("Text", S.truncate(said)).where("Text <> ''"),
        "tools": base.where((F.col("record") == "response_item") & ~user & ~assistant & (F.col("kind") != "reasoning")),
        "errors": df.where("v is null AND trim(line) <> ''").select("source_file", "source_line", F.lit("invalid JSON").alias("Error"))}


def summary_counts(timeline: DataFrame) -> DataFrame:
    """Rows by category and agent; a blank agent counts as unknown."""
    return timeline.groupBy("Category", F.when(S.strip(S.text("Agent")) == "", "unknown").otherwise(F.col("Agent")).alias("Agent")).agg(F.count(F.lit(1)).alias("Count"))


def artifact_counts(manifest: DataFrame, path: str = "SourcePath", error: str = "Error") -> DataFrame:
    ok = S.text(error) == ""
    return manifest.agg(F.count_if(ok).alias("artifacts"), F.count_if(ok & F.col(path).contains("/.codex/")).alias("codex"), F.count_if(ok & F.col(path).contains("/.gemini/")).alias("gemini"), F.count_if(~ok).alias("errors"))
