"""SQLite databases: a Python data source with one partition per (file, table), and the runtime-log adapter."""

from __future__ import annotations

import os
import sqlite3
import sys
import tempfile

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trailspark.functions import patterns as P
from trailspark.functions import scalars as S
from trailspark.operators.events import conform

cloudpickle.register_pickle_by_value(sys.modules["trailspark"])

BODY = ("feedback_log_body", "body", "message", "text", "content")
TIME = ("timestamp", "created_at", "ts", "time")
OTHER = ("level", "target", "thread_id", "process_uuid")
ROWS = "path string, tbl string, row_id long, ts string, ts_numeric boolean, body string, level string, target string, thread_id string, process_uuid string"


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _text(v) -> str:
    return "" if v is None else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


def tables(conn: sqlite3.Connection) -> list[str]:
    return [r[0] for r in conn.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]


def log_rows(conn: sqlite3.Connection, path: str, table: str):
    """Rows of one table that has a body column; only the columns in use are read."""
    try:
        names = {r[1].lower(): r[1] for r in conn.execute(f"PRAGMA table_info({_quoted(table)})")}
        first = lambda options: next((names[o] for o in options if o in names), None)
        body, time = first(BODY), first(TIME)
        if body is None:
            return
        picked = [time, body, *(first((o,)) for o in OTHER)]
        query = f"SELECT rowid, {', '.join(_quoted(p) if p else 'NULL' for p in picked)} FROM {_quoted(table)}"
        for row_id, ts, text, *rest in conn.execute(query):
            if text not in (None, "", 0):
                yield (path, table, row_id, _text(ts), isinstance(ts, (int, float)), _text(text), *("None" if v is None and p else _text(v) for v, p in zip(rest, picked[2:])))
    except sqlite3.Error:  # not a readable table: its rows cannot be evidence
        return


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", file)``: log rows of every table with a body column."""

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        return ROWS

    def reader(self, schema):
        return SqliteReader(self.options.get("path"))


class SqliteReader(DataSourceReader):
    def __init__(self, path):
        self.path = path.removeprefix("file://").removeprefix("file:")

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as conn:
            return [InputPartition(t) for t in tables(conn)]

    def read(self, partition):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as conn:
            yield from log_rows(conn, self.path, partition.value)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)


def read_databases(files: DataFrame) -> DataFrame:
    """Log rows of database files given as (path, content), from any store Spark reads."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                fd, name = tempfile.mkstemp(suffix=".db")
                try:
                    with os.fdopen(fd, "wb") as f:
                        f.write(content)
                    conn = sqlite3.connect(f"file:{name}?mode=ro&immutable=1", uri=True)
                    try:
                        rows = [r for t in tables(conn) for r in log_rows(conn, path, t)]
                    except sqlite3.Error:
                        rows = []
                    finally:
                        conn.close()
                finally:
                    os.unlink(name)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])

    return files.select("path", "content").mapInPandas(run, ROWS)


def parse_databases(files: DataFrame) -> DataFrame:
    """Events of runtime logs: prompts by pattern, then answers, tools and the rest."""
    rows = read_databases(files)
    prompt = F.regexp_extract("body", P.SQLITE_PROMPT, 1)
    pick = lambda a, b, c, d: F.when(prompt != "", a).when(F.col("body").rlike(P.SQLITE_ASSISTANT), b).when(F.col("body").rlike(P.SQLITE_TOOL), c).otherwise(d)
    return conform(rows.select(
        F.when(F.col("ts_numeric"), S.iso_epoch(F.col("ts").try_cast("double"))).otherwise(S.iso_utc(F.col("ts"))).alias("timestamp_utc"), F.lit("codex").alias("agent"),
        pick("Prompt", "AssistantMessage", "ToolOrAction", "Runtime").alias("category"), pick("UserInput", "AssistantOutput", "RuntimeToolEvent", "SQLiteRecord").alias("action"), prompt.alias("text"),
        F.left("body", F.lit(20_000)).alias("details"), "level", "target", F.col("thread_id").alias("session_id"), F.col("process_uuid").alias("process_id"), F.concat(F.lit("sqlite:"), "tbl").alias("source_type"),
        F.col("path").alias("source_file"), F.col("row_id").cast("string").alias("source_line"), S.hash_text(F.col("body")).alias("evidence_hash"),
        F.to_json(F.struct(F.col("tbl").alias("table"), F.lit(False).alias("conversation_eligible"), F.lit("sqlite_runtime").alias("conversation_source"))).alias("metadata"),
        F.concat_ws(":", F.lpad(F.col("row_id").cast("string"), 12, "0"), "tbl").alias("ingest_ord")))
