"""Artifact files: discovery, archives, adapters and ingestion."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions import json_walk
from trailspark.functions import patterns as P
from trailspark.functions import scalars as S
from trailspark.operators.events import conform

#: Names of generated outputs, which are no evidence.
GENERATED = (
    "codex_timeline.csv codex_timeline.jsonl codex_prompts.jsonl codex_assistantmessages.jsonl codex_toolactivity.jsonl ai_agent_timeline.csv ai_agent_timeline.jsonl case_replay.csv analytics.json indicators.csv "
    "indicators_stix_2.1.json ingestion_diagnostics.csv summary.json artifact_inventory.csv sha256sums.txt").split()
JSON_FOLDERS = ("/.claude/", "/.gemini/", "/.cursor/", "/.windsurf/", "/.continue/", "/.aider/")
#: Agents by what a path contains, first hit counts.
HINTS = ("claude", "gemini", "aider", "continue", "cursor", "windsurf", "copilot")
JSON_HINTS = ("codex", "claude", "cursor", "windsurf", "continue", "copilot", "aider", "gemini")
DETAIL = 20_000


def lower_path() -> Column:
    return F.lower(F.regexp_replace("path", r"\\", "/"))


def is_artifact() -> Column:
    """Which listed files are evidence."""
    low = lower_path()
    name, suffix = S.basename(low), F.regexp_extract(S.basename(low), r"(\.[^.]+)$", 1)
    gemini = low.contains("/.gemini/antigravity-cli/brain/") & low.contains("/.system_generated/logs/") & (name == "transcript_full.jsonl")
    lines = suffix.isin(".jsonl", ".ndjson") & (low.contains("/.codex/sessions/") | (name == "session_index.jsonl") | gemini)
    return ~name.isin(*GENERATED) & ~name.rlike("-(wal|shm)$") & (lines | suffix.isin(".sqlite", ".sqlite3", ".db") | ((suffix == ".json") & S.has_any(low, JSON_FOLDERS)))


def visible_roots(spark: SparkSession, *inputs: str) -> list[str]:
    """The inputs and, below them, every folder that Spark's listing would pass over as hidden.

    Agents keep their evidence in such folders. Only names are listed here, on the driver; contents are read by tasks.
    """
    jvm, conf, roots = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for given in inputs:
        top = jvm.org.apache.hadoop.fs.Path(given)
        fs = top.getFileSystem(conf)
        base = fs.makeQualified(top).toString().rstrip("/")
        roots.append(base)
        found, names = set(), fs.listFiles(top, True)
        while names.hasNext():
            parts = names.next().getPath().toString()[len(base) :].strip("/").split("/")[:-1]
            found.update("/".join(parts[: i + 1]) for i, p in enumerate(parts) if p.startswith((".", "_")))
        roots += [f"{base}/{f}" for f in sorted(found)]
    return roots


FILE = "path string, content binary, length long, modificationTime timestamp, error string"


def read_files(spark: SparkSession, *inputs: str) -> DataFrame:
    """(path, content, length, modificationTime, error) of the files under the inputs, each once.

    An input that is itself an archive is expanded, its members' paths being ``name.zip!/member``; archives found inside a
    folder are files like any other. A broken archive, or a broken member, gives a row with ``error`` and no content.
    """
    archives = [i for i in inputs if i.rstrip("/").lower().endswith(".zip")]
    folders = [i for i in inputs if i not in archives]

    def members(batches):
        for pdf in batches:
            for path, content, when in zip(pdf["path"], pdf["content"], pdf["modificationTime"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    yield pd.DataFrame({"path": [path], "content": [None], "length": [0], "modificationTime": [when], "error": [str(e)]})
                    continue
                for m in z.infolist():
                    if m.is_dir():
                        continue
                    data, error = None, None
                    try:
                        data = z.read(m)
                    except (zipfile.BadZipFile, OSError, ValueError, RuntimeError, NotImplementedError, zlib.error) as e:
                        error = str(e) or type(e).__name__
                    yield pd.DataFrame({"path": [f"{path}!/{m.filename}"], "content": [data], "length": [len(data or b"")], "modificationTime": [when], "error": [error]})

    def load(paths: list[str]) -> DataFrame:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        return read.load(sorted(set(paths))).select("path", "content", "length", "modificationTime")

    parts = []
    if folders:
        parts.append(load(visible_roots(spark, *folders)).withColumn("error", F.lit(None).cast("string")))
    if archives:
        parts.append(load(archives).mapInPandas(members, FILE))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def lines_of(files: DataFrame) -> DataFrame:
    """(source_file, source_line from 1, line without its end, whole: the line with its newline as LF)."""
    body = F.regexp_replace(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\\ufeff", ""), "\\r\\n|\\r", "\n")
    rows = files.select(F.col("path").alias("source_file"), body.alias("_b")).select("source_file", F.posexplode(F.split("_b", "\n", -1)).alias("_i", "line"), F.size(F.split("_b", "\n", -1)).alias("_n"))
    rows = rows.where((F.col("_i") + 1 < F.col("_n")) | (F.col("line") != ""))
    return rows.select("source_file", (F.col("_i") + 1).alias("source_line"), "line", F.when(F.col("_i") + 1 < F.col("_n"), F.concat("line", F.lit("\n"))).otherwise(F.col("line")).alias("whole"))


def _ordinal(emit: Column | int = 0, line: str = "source_line") -> Column:
    e = F.lit(emit) if isinstance(emit, int) else emit
    return F.concat_ws(":", F.lpad(F.col(line).cast("string"), 12, "0"), F.lpad(e.cast("string"), 6, "0"))


IDS = {
    "username": ("username", "user"), "hostname": ("hostname", "computer"), "session_id": ("thread_id", "session_id", "conversation_id"), "turn_id": ("turn_id", "id"), "call_id": ("call_id",),
    "process_id": ("process_uuid", "process_id"), "tool_name": ("tool_name", "name"), "model": ("model",), "working_directory": ("cwd", "working_directory")}
JSONL_IDS = IDS | {
    "username": ("username", "user_name"), "session_id": ("session_id", "conversation_id", "thread_id", "chat_id"), "turn_id": ("turn_id", "message_id", "id"), "call_id": ("call_id", "tool_call_id"),
    "tool_name": ("tool_name", "function_name", "name"), "model": ("model", "model_name"), "working_directory": ("cwd", "working_directory", "project_path"), "action": ("type", "event", "action"),
    "tool": ("tool_name", "function_name", "command")}


def _val(name: str) -> Column:
    return F.coalesce(F.try_element_at("r.vals", F.lit(name)), F.lit(""))


def parse_codex(files: DataFrame) -> DataFrame:
    """Session envelopes: one event per valid line; broken lines are passed over."""
    df = lines_of(files).withColumn("r", json_walk.record(F.col("line"), IDS, payload=True)).where("r.ok")
    user, agent = F.col("r.role").isin("user", "human"), F.col("r.role").isin("assistant", "ai")
    prompt = user & (F.col("r.text") != "") & ~F.col("r.text").startswith("<")
    answer = agent & (F.col("r.text") != "")
    tool = (_val("tool_name") != "") | F.col("r.flat").rlike("(?i)function_call|tool_call|exec_command|apply_patch")
    pick = lambda a, b, c, d: F.when(prompt, a).when(answer, b).when(tool, c).otherwise(d)
    text = F.when(prompt | answer, F.col("r.text")).otherwise("")
    details = F.when(prompt | answer, "").otherwise(F.left("r.flat", F.lit(DETAIL)))
    usage = F.get_json_object("r.payload", "$.info.total_token_usage")
    tokens = F.from_json(F.when(usage.startswith("{"), usage), "struct<input_tokens string, cached_input_tokens string, output_tokens string, reasoning_output_tokens string, total_tokens string>")
    eligible = F.col("r.role").isin("user", "human", "assistant", "ai") & (F.col("r.text") != "")
    counted = F.col("r.payload") != ""
    meta = F.to_json(F.struct(_val("type").alias("record_type"), F.col("r.role").alias("role"), eligible.alias("conversation_eligible"), F.lit("raw_session_jsonl").alias("conversation_source"),
                              *[F.when(counted, F.coalesce(tokens[k], F.lit(""))).alias(k) for k in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")],
                              F.when(counted, "cumulative").alias("token_usage_kind")))
    return conform(df.select(
        json_walk.time_of("r").alias("timestamp_utc"), F.lit("codex").alias("agent"), pick("Prompt", "AssistantMessage", "ToolOrAction", "SessionOrTurn").alias("category"),
        pick("UserInput", "AssistantOutput", "ToolEvent", "SessionEvent").alias("action"), text.alias("text"), details.alias("details"), *[_val(k).alias(k) for k in IDS], F.lit("codex_session_jsonl").alias("source_type"),
        "source_file", F.col("source_line").cast("string").alias("source_line"), S.hash_text(F.concat(text, F.lit("\n"), details)).alias("evidence_hash"), meta.alias("metadata"), _val("type").alias("record_type"),
        F.col("r.role").alias("role"), eligible.alias("conversation_eligible"), F.when(counted, "cumulative").otherwise("").alias("token_usage_kind"), _ordinal().alias("ingest_ord")))


def gemini_session(path: Column) -> Column:
    """The component after ``brain``, else the folder above the file's."""
    parts = F.split(path, "/")
    brain = F.regexp_extract(path, r"(?i)(?:^|/)brain/([^/]+)", 1)
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    return S.first_text(brain, F.coalesce(F.try_element_at(parts, F.lit(-3)), F.lit("")), stem)


def user_request(content: Column) -> Column:
    inner = F.regexp_extract(content, r"(?is)<USER_REQUEST>\s*(.*?)\s*</USER_REQUEST>", 1)
    return F.when(content.rlike(r"(?is)<USER_REQUEST>.*?</USER_REQUEST>"), S.strip(inner)).otherwise(S.strip(content))


def compact_arguments(args: Column, upper: bool = False) -> Column:
    """Arguments (map of JSON texts) with bulk contents replaced by length and hash, as JSON."""
    bulk = ("CodeContent", "Base64", "ImageBytes")
    case = F.upper if upper else (lambda c: c)
    text = lambda v: F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v"), v)
    member = lambda k, v: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.char_length(F.to_json(F.array(k))) - 2), F.lit(": "), v)
    kept = F.transform(F.map_entries(args), lambda e: F.when(~e["key"].isin(*bulk), member(e["key"], e["value"])).when(
        e["value"].startswith('"'), F.concat(member(F.concat(e["key"], F.lit("Length")), F.char_length(text(e["value"])).cast("string")), F.lit(", "), member(F.concat(e["key"], F.lit("SHA256")), F.concat(F.lit('"'), case(S.hash_text(text(e["value"]))), F.lit('"'))))))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(kept), ", "), F.lit("}"))


def parse_gemini(files: DataFrame, list_dir: str = "read_file") -> DataFrame:
    """Transcripts: a line gives a prompt, or an answer, tool calls, thinking and other content, in that order."""
    @F.pandas_udf("array<struct<k:string,v:string>>")
    def top(s: pd.Series) -> pd.Series:
        import json

        def one(line):
            try:
                obj = json.loads(line)
            except ValueError:
                return None
            return [(k, v if isinstance(v, str) and k != "tool_calls" else "" if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list, str)) else str(v)) for k, v in obj.items()] if isinstance(obj, dict) else None

        return s.map(one)

    @F.pandas_udf("array<struct<i:int,name:string,args:map<string,string>,raw:string>>")
    def calls(s: pd.Series) -> pd.Series:
        import json

        def one(text):
            found = json.loads(text) if text else []
            out = []
            for i, c in enumerate(found if isinstance(found, list) else []):
                if isinstance(c, dict):
                    a = c.get("args", {})
                    a = a if isinstance(a, dict) else {"value": a}
                    out.append((i, json_walk.shown(c.get("name") or ""), {k: json.dumps(v, ensure_ascii=False) for k, v in a.items()}, json.dumps(a, ensure_ascii=False)))
            return out

        return s.map(one)

    df = lines_of(files).where(S.strip(F.col("line")) != "").withColumn("m", F.map_from_entries(top("line"))).where("m is not null")
    f = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(""))
    df = df.select("source_file", "source_line", "whole", json_iso(f("created_at")).alias("timestamp_utc"), f("step_index").alias("step"), F.upper(f("source")).alias("src"), F.upper(f("type")).alias("kind"), f("status").alias("status"),
                   f("content").alias("content"), f("thinking").alias("thinking"), calls(f("tool_calls")).alias("calls"))
    is_user, is_plan = (F.col("src") == "USER_EXPLICIT") & (F.col("kind") == "USER_INPUT"), (F.col("src") == "MODEL") & (F.col("kind") == "PLANNER_RESPONSE")
    arg = lambda c, k: F.coalesce(F.get_json_object(c["raw"], f"$.{k}"), F.lit(""))
    base = [("record_type", F.col("kind")), ("gemini_source", F.col("src")), ("status", F.col("status")), ("step_index", F.col("step")), ("conversation_source", F.lit("raw_gemini_transcript_jsonl"))]
    meta = lambda role, ok, **more: F.to_json(F.struct(*[v.alias(k) for k, v in base], role.alias("role"), F.lit(ok).alias("conversation_eligible"), *[v.alias(k) for k, v in more.items()]))

    def event(cond, emit, category, action, hashed, metadata, role=F.lit(""), ok=False, text=F.lit(""), details=F.lit(""), call=F.lit(""), tool=F.lit(""), cwd=F.lit(""), target=F.lit("")):
        fields = dict(emit=emit, category=category, action=action, text=text, details=details, call_id=call, tool_name=tool, working_directory=cwd, target=target, evidence_hash=S.hash_text(hashed), metadata=metadata, role=role)
        return F.when(cond, F.struct(*[(v.cast("int") if k == "emit" else v.cast("string")).alias(k) for k, v in fields.items()], F.lit(ok).alias("conversation_eligible")))

    def call_event(c):
        name = c["name"]
        action = F.when(name == "run_command", "exec_command").when(name == "write_to_file", "write_file").when(name == "list_dir", list_dir).when(name == "ask_permission", "approval_request").otherwise(S.first_text(name, F.lit("ToolEvent")))
        target = S.first_text(*[arg(c, k) for k in ("TargetFile", "DirectoryPath", "Target", "ImageName")])
        details = F.concat(F.lit('{"tool_name": '), F.expr("to_json(array('x'))").substr(1, 0), F.lit('"'), F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('", "args": '), compact_arguments(c["args"]), F.lit("}"))
        m = meta(F.lit(""), False, tool_call_index=c["i"], tool_args=F.parse_json(c["raw"]), command=F.nullif(arg(c, "CommandLine"), F.lit("")))
        return event(~is_user, c["i"] + 1, F.lit("ToolOrAction"), action, F.concat("whole", F.lit("\nTOOL_INDEX="), c["i"].cast("string")), m, details=details, call=F.concat("step", F.lit(":"), c["i"].cast("string")), tool=name, cwd=arg(c, "Cwd"), target=target)

    content, thinking = S.strip(F.col("content")), S.strip(F.col("thinking"))
    other = F.when((F.col("src") == "MODEL") & ~F.col("kind").isin("CHECKPOINT", "CONVERSATION_HISTORY"), "ToolOrAction").otherwise("SessionOrTurn")
    system = F.when(F.col("src") == "SYSTEM", "system").otherwise("")
    ask = user_request(F.col("content"))
    every = F.concat(
        F.array(event(is_user & (ask != ""), F.lit(0), F.lit("Prompt"), F.lit("UserInput"), F.col("whole"), meta(F.lit("user"), True), F.lit("user"), True, text=ask),
                event(is_plan & (content != ""), F.lit(0), F.lit("AssistantMessage"), F.lit("AssistantOutput"), F.col("whole"), meta(F.lit("assistant"), True), F.lit("assistant"), True, text=content)),
        F.transform("calls", call_event),
        F.array(event(~is_user & (thinking != ""), F.lit(900_000), F.lit("SessionOrTurn"), F.lit("ModelReasoning"), F.concat("whole", F.lit("\nTHINKING")), meta(F.lit(""), False, reasoning=F.lit(True)), details=thinking),
                event(~is_user & ~is_plan & (content != ""), F.lit(900_001), other, S.first_text(F.col("kind"), F.lit("GeminiRecord")), F.col("whole"), meta(system, False), system, details=F.left("content", F.lit(DETAIL)))))
    out = df.select("source_file", "source_line", "timestamp_utc", "step", "kind", F.explode(F.array_compact(every)).alias("e")).select("*", "e.*")
    return conform(out.select("*", F.lit("gemini").alias("agent"), gemini_session(F.col("source_file")).alias("session_id"), F.col("step").alias("turn_id"), F.lit("gemini_antigravity_jsonl").alias("source_type"),
                              F.col("kind").alias("record_type"), _ordinal(F.col("emit")).alias("ingest_ord")))


def json_iso(c: Column) -> Column:
    """A JSON scalar as time: digits are an epoch, other text ISO."""
    return F.when(c.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), S.iso_epoch(c.try_cast("double"))).otherwise(S.iso_utc(c))


def _hinted(names: tuple[str, ...]) -> Column:
    out = F.lit("codex")
    for n in reversed(names):
        out = F.when(F.lower("source_file").contains(n), n).otherwise(out)
    return out


def parse_jsonl(files: DataFrame) -> DataFrame:
    """Best-effort JSON lines of any agent, objects only."""
    df = lines_of(files).withColumn("r", json_walk.record(F.col("line"), JSONL_IDS, payload=False)).where("r.ok AND r.object").withColumn("agent", _hinted(HINTS))
    said = F.col("r.text") != ""
    prompt, answer = F.col("r.role").isin("user", "human") & said, F.col("r.role").isin("assistant", "ai", "model") & said
    tool = (_val("tool") != "") | F.col("r.flat").rlike("(?i)tool|command|shell|patch")
    category = F.when(prompt, "Prompt").when(answer, "AssistantMessage").when(tool, "ToolOrAction").otherwise("Runtime")
    action = F.when(prompt, "UserInput").when(answer, "AssistantOutput").when(tool, S.first_text(_val("action"), F.lit("ToolEvent"))).otherwise(_val("action"))
    return conform(df.select(
        json_walk.time_of("r").alias("timestamp_utc"), "agent", category.alias("category"), action.alias("action"), F.when(prompt | answer, F.col("r.text")).otherwise("").alias("text"),
        F.when(prompt | answer, "").otherwise(F.left("r.flat", F.lit(DETAIL))).alias("details"), *[_val(k).alias(k) for k in IDS], F.concat("agent", F.lit("_jsonl")).alias("source_type"), "source_file",
        F.col("source_line").cast("string").alias("source_line"), S.hash_text(F.concat("r.text", F.lit("\n"), "r.flat")).alias("evidence_hash"), F.lit('{"adapter_confidence": "best-effort"}').alias("metadata"), _ordinal().alias("ingest_ord")))


def parse_json(files: DataFrame) -> DataFrame:
    """Whole-file JSON: records with text, containers before the messages they hold."""
    docs = files.select(F.col("path").alias("source_file"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\\ufeff", "").alias("doc"))
    rows = docs.select("source_file", F.posexplode(json_walk.expand(F.col("doc"))).alias("_i", "line")).withColumn("source_line", F.col("_i") + 1)
    names = {k: JSONL_IDS[k] for k in ("session_id", "turn_id", "model", "working_directory")}
    df = rows.withColumn("r", json_walk.record(F.col("line"), names, payload=False)).where("r.text <> ''").withColumn("agent", _hinted(JSON_HINTS))
    prompt, answer = F.col("r.role").isin("user", "human"), F.col("r.role").isin("assistant", "ai", "model")
    pick = lambda a, b, c: F.when(prompt, a).when(answer, b).otherwise(c)
    return conform(df.select(
        json_walk.time_of("r").alias("timestamp_utc"), "agent", pick("Prompt", "AssistantMessage", "Runtime").alias("category"), pick("UserInput", "AssistantOutput", "Record").alias("action"),
        F.when(prompt | answer, F.col("r.text")).otherwise("").alias("text"), F.when(prompt | answer, "").otherwise(F.left("r.flat", F.lit(DETAIL))).alias("details"), *[_val(k).alias(k) for k in names],
        F.concat("agent", F.lit("_json")).alias("source_type"), "source_file", F.col("source_line").cast("string").alias("source_line"), S.hash_text(F.col("r.text")).alias("evidence_hash"),
        F.lit('{"adapter_confidence": "best-effort"}').alias("metadata"), _ordinal().alias("ingest_ord")))


@dataclass(frozen=True)
class Adapter:
    """An input format: which files it takes (a predicate over path and ``sample``) and how they become events."""

    name: str
    priority: int
    matches: Callable[[], Column]
    parse: Callable[[DataFrame], DataFrame]


def _suffix(*ends: str) -> Column:
    out = F.lit(False)
    for e in ends:
        out = out | lower_path().endswith(e)
    return out


def parse_sqlite(files: DataFrame) -> DataFrame:
    from trailspark.sources.sqlite import parse_databases

    return parse_databases(files)


ADAPTERS = (
    Adapter("gemini-antigravity", 95, lambda: _suffix(".jsonl", ".ndjson") & lower_path().contains("/.gemini/antigravity-cli/brain/") & (
        (S.basename(lower_path()) == "transcript_full.jsonl") | (F.col("sample").contains('"step_index"') & F.col("sample").contains('"source"') & F.col("sample").contains('"type"') & F.col("sample").contains('"created_at"'))), parse_gemini),
    Adapter("codex-session", 90, lambda: _suffix(".jsonl") & (lower_path().contains(".codex") | lower_path().contains("sessions")) & F.col("sample").contains('"payload"'), parse_codex),
    Adapter("sqlite", 80, lambda: _suffix(".sqlite", ".sqlite3", ".db") | S.basename(lower_path()).startswith("logs_"), parse_sqlite),
    Adapter("multi-agent-jsonl", 40, lambda: _suffix(".jsonl", ".ndjson") & S.strip(F.col("sample")).startswith("{"), parse_jsonl),
    Adapter("multi-agent-json", 30, lambda: _suffix(".json") & S.strip(F.col("sample")).rlike(r"^[{\[]"), parse_json),
)


def dispatch(files: DataFrame, adapters: tuple[Adapter, ...] = ADAPTERS) -> DataFrame:
    """Artifact files with the name of the adapter of highest priority that takes them (null: none). The path test comes
    before any content is read."""
    df = files if "error" in files.columns else files.withColumn("error", F.lit(None).cast("string"))
    df = df.where(is_artifact() | F.col("error").isNotNull()).withColumn("sample", F.make_valid_utf8(F.substring("content", 1, 8192).cast("string")))
    chosen = F.lit(None).cast("string")
    for a in sorted(adapters, key=lambda a: a.priority):
        chosen = F.when(a.matches(), a.name).otherwise(chosen)
    return df.withColumn("adapter", F.when(F.col("error").isNull(), chosen)).drop("sample")


def broken(adapter: Column, content: Column) -> Column:
    """Why a file cannot be parsed at all, as its adapter would say; null where it can."""
    text = F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\\ufeff", "")
    no_json = (adapter == "multi-agent-json") & F.try_parse_json(text).isNull()
    no_database = (adapter == "sqlite") & (F.octet_length(content) > 0) & ~(F.substring(content, 1, 15).cast("string") == "SQLite format 3")
    return F.when(no_json, "not valid JSON").when(no_database, "file is not a database")


def ingest(files: DataFrame, adapters: tuple[Adapter, ...] = ADAPTERS) -> tuple[DataFrame, DataFrame]:
    """(events, diagnostics) of a listing of files. A file that cannot be read or parsed gives a diagnostic and no event, and the others go on."""
    found, events = dispatch(files, adapters).withColumn("why", broken(F.col("adapter"), F.col("content"))), None
    for a in adapters:
        part = a.parse(found.where((F.col("adapter") == a.name) & F.col("why").isNull()).drop("why", "error"))
        events = part if events is None else events.unionByName(part)
    per = events.groupBy(F.col("source_file").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    detail = F.concat("adapter", F.lit(": "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" events"))
    status = F.when(F.col("error").isNotNull(), "read-error").when(F.col("adapter").isNull(), "unsupported").when(F.col("why").isNotNull(), "parse-error").otherwise("parsed")
    said = F.when(status == "read-error", F.col("error")).when(status == "unsupported", "").when(status == "parse-error", F.concat("adapter", F.lit(": "), "why")).otherwise(detail)
    return events, found.select("path", "adapter", "error", "why").join(per, "path", "left").select(F.col("path").alias("file"), status.alias("status"), said.alias("detail"))


def manifest(files: DataFrame) -> DataFrame:
    """Collection manifest: agent, source, size, sha256, type and time of every file in an agent's folders."""
    from trailspark.operators.collector import AGENT_ROOTS, artifact_type

    agent = F.lit(None).cast("string")
    for name, roots in AGENT_ROOTS.items():
        for r in roots:
            agent = F.when(F.col("path").contains(f"/{r}/") | F.col("path").endswith(f"/{r}"), F.coalesce(agent, F.lit(name))).otherwise(agent)
    return files.select(agent.alias("agent"), F.col("path").alias("source"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), artifact_type(F.col("path")).alias("artifact_type"),
                        S.mtime_utc(F.col("modificationTime")).alias("modified_utc"), F.lit("").alias("error")).where("agent is not null")
