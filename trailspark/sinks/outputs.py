"""Sinks: the case folder. Spark writes the distributed part; the driver finishes single files from bounded or
streamed rows."""

from __future__ import annotations

import csv
import datetime as dt
import hashlib
import json
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspark.functions import repair
from trailspark.operators import indicators, redact
from trailspark.sinks.report import render

TIMELINE_FIELDS = (
    "event_number timestamp_utc delta_seconds agent event_type category action summary username hostname session_key correlation_key session_id turn_id call_id process_id tool_name model_detected input_tokens output_tokens "
    "reasoning working_directory target paths path_records urls domains api_endpoints commands git_operations secret_findings text details source_type source_file source_line evidence_hash metadata").split()
REPLAY_FIELDS = "timestamp_utc event_number session_key agent role event_type message".split()
IOC_FIELDS = "type value first_seen last_seen count agents source_events".split()


def csv_rows(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields as text in order; lists and structures as JSON, nulls and missing fields empty."""
    kinds = {f.name: f.dataType for f in df.schema}
    cell = lambda c: F.to_json(c) if isinstance(kinds[c], (T.ArrayType, T.StructType, T.MapType)) else F.col(c).cast("string")
    return df.select(*[(F.coalesce(cell(c), F.lit("")) if c in kinds else F.lit("")).alias(c) for c in fields])


def write_csv(df: DataFrame, path: Path, fields: list[str]) -> None:
    """One UTF-8 file with a byte-order mark; rows stream through the driver, never all at once."""
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(fields)
        for r in csv_rows(df, fields).toLocalIterator(prefetchPartitions=True):
            out.writerow(list(r))


def write_csv_parts(df: DataFrame, path: str, fields: list[str]) -> None:
    """The distributed form: a folder of CSV parts."""
    csv_rows(df, fields).write.csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: Path) -> None:
    with path.open("w", encoding="utf-8") as f:
        for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator(prefetchPartitions=True):
            f.write(r["j"] + "\n")


def write_stix(iocs: DataFrame, path: Path) -> None:
    now = dt.datetime.now(dt.timezone.utc).isoformat().replace("+00:00", "Z")
    rows = (r["j"] for r in indicators.stix_objects(iocs, now).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator())
    with path.open("w", encoding="utf-8") as f:
        f.write(json.dumps({"type": "bundle", "id": f"bundle--{uuid.uuid4()}"}, indent=2)[:-2] + ',\n  "objects": [')
        for i, j in enumerate(rows):
            f.write((",\n    " if i else "\n    ") + j)
        f.write("\n  ]\n}")


def _counts(df: DataFrame) -> dict:
    return {r["value"]: r["count"] for r in df.collect()}


def gather_analytics(stats: dict[str, DataFrame], ioc_count: int) -> dict:
    """The rollups as one document; each is a top list or keyed by a small domain."""
    out = stats["totals"].first().asDict()
    out |= {name: _counts(df) for name, df in stats.items() if df.columns == ["value", "count"]}
    out["event_types"], out["agents"] = _counts(stats["event_types"]), _counts(stats["agents"])
    out["interesting_paths"] = [r.asDict() for r in stats["interesting_paths"].collect()]
    out["user_projects"] = [r.asDict(True) for r in stats["user_projects"].collect()]
    cats: dict[str, dict] = {}
    for r in stats["categorized_paths"].orderBy("category", F.desc("count"), "path").collect():
        cats.setdefault(r["category"], {})[r["path"]] = r["count"]
    return out | {"categorized_paths": cats, "ioc_count": ioc_count, "token_usage": stats["token_usage"].first().asDict()}


def hash_list(folder: Path) -> None:
    """SHA256SUMS.txt over every other file of the folder, by name."""
    names = sorted(p for p in folder.iterdir() if p.is_file() and p.name != "SHA256SUMS.txt")
    (folder / "SHA256SUMS.txt").write_text("".join(f"{hashlib.sha256(p.read_bytes()).hexdigest()}  {p.name}\n" for p in names), encoding="utf-8")


def safe_replay(replay: DataFrame) -> DataFrame:
    return redact.redact_column(replay.withColumn("message", repair.normalized(F.col("message"))), "message")


def write_case(output: str, events: DataFrame, replay: DataFrame, iocs: DataFrame, stats: dict[str, DataFrame], diagnostics: DataFrame, redact_metadata: bool = True, report_rows: int = 20_000) -> dict:
    """All files of a case; secrets are masked first. Returns the analytics document. The report shows the first
    ``report_rows`` events, messages and indicators and says so; the other files are whole."""
    folder = Path(output)
    folder.mkdir(parents=True, exist_ok=True)
    safe, talk, marks = redact.redact_events(events, redact_metadata).persist(), safe_replay(replay).persist(), redact.redact_column(iocs, "value", "redacted").persist()
    write_csv(safe.orderBy("event_number"), folder / "AI_Agent_Timeline.csv", TIMELINE_FIELDS)
    write_jsonl(safe.drop("meta", "ingest_ord").orderBy("event_number"), folder / "AI_Agent_Timeline.jsonl")
    write_csv(talk, folder / "Case_Replay.csv", REPLAY_FIELDS)
    write_csv(marks, folder / "Indicators.csv", IOC_FIELDS)
    write_stix(marks, folder / "Indicators_STIX_2.1.json")
    doc = gather_analytics(stats, iocs.count())
    (folder / "Analytics.json").write_text(json.dumps(doc, indent=2, default=str), encoding="utf-8")
    write_csv(diagnostics, folder / "Ingestion_Diagnostics.csv", ["file", "status", "detail"])
    (folder / "AI_Agent_Report.html").write_text(render(safe, talk, marks, doc, diagnostics, report_rows), encoding="utf-8")
    hash_list(folder)
    for df in (safe, talk, marks):
        df.unpersist()
    return doc


def write_diagnostics(output: str, diagnostics: DataFrame) -> None:
    Path(output).mkdir(parents=True, exist_ok=True)
    write_csv(diagnostics, Path(output) / "Ingestion_Diagnostics.csv", ["file", "status", "detail"])


def zip_folder(folder: str, archive: str) -> None:
    """Zip a folder; times before 1980, which the format cannot hold, become 1980."""
    root = Path(folder)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file():
                when = max(time.localtime(p.stat().st_mtime)[:6], (1980, 1, 1, 0, 0, 0))
                info = zipfile.ZipInfo(p.relative_to(root).as_posix(), when)
                info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, (p.stat().st_mode & 0xFFFF) << 16
                z.writestr(info, p.read_bytes())


def export_collector(tables: dict[str, DataFrame], output: str) -> None:
    """Collector tables by name, sorted, as CSV and JSON parts."""
    from trailspark.operators.collector import sorted_rows

    for name, df in tables.items():
        sorted_rows(df).write.csv(f"{output}/{name}_csv", header=True, escape='"')
        sorted_rows(df).write.json(f"{output}/{name}_jsonl")
