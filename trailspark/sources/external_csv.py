"""External telemetry in CSV form, with headers of many dialects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions import scalars as S
from trailspark.operators.events import conform

TIME = ("timestamputc", "timestamp", "time", "datetime", "@timestamp")
TEXT = ("message", "details", "event", "commandline", "process_command_line")
ACTION = ("category", "event_type", "eventtype", "source")
USER, HOST, PROCESS = ("username", "user"), ("hostname", "computer", "device_name"), ("process_id", "pid")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, encoding="UTF-8")
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def telemetry_events(rows: DataFrame, source_file: str, line: str | None = None, compat: bool = False) -> DataFrame:
    """Any flat table of texts as external events. Time, text and action take the first non-empty synonym;
    user, host and process the first present one. ``compat`` writes missing cells as the text None."""
    skip = {line} if line else set()
    names = {c.lower(): c for c in rows.columns if c not in skip}
    cell = lambda c: S.text(F.col(f"`{names[c]}`"))
    some = lambda options, default="": S.first_text(*[cell(o) for o in options if o in names], F.lit(default))
    blank = "None" if compat else ""
    here = lambda options: next((F.coalesce(F.col(f"`{names[o]}`").cast("string"), F.lit(blank)) for o in options if o in names), F.lit(""))
    meta = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in names.values()]), {"ignoreNullFields": "false"})
    if line is None:
        rows, line = rows.withColumn("_line", F.monotonically_increasing_id() + 2), "_line"
    at = F.col(f"`{line}`").cast("string")
    return conform(rows.select(
        S.iso_utc(some(TIME)).alias("timestamp_utc"), F.lit("external").alias("agent"), F.lit("ExternalTelemetry").alias("category"), some(ACTION, "ExternalTelemetry").alias("action"), some(TEXT).alias("text"), meta.alias("details"),
        here(USER).alias("username"), here(HOST).alias("hostname"), here(PROCESS).alias("process_id"), F.lit("external_csv").alias("source_type"), F.lit(source_file).alias("source_file"), at.alias("source_line"),
        S.hash_text(meta).alias("evidence_hash"), meta.alias("metadata"), F.lpad(at, 20, "0").alias("ingest_ord")))


def import_csv(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    return telemetry_events(read_csv(spark, path), path, compat=compat)


def union_events(*parts: DataFrame) -> DataFrame:
    """Bag union of event tables in the event schema."""
    return reduce(lambda a, b: a.unionByName(b), map(conform, parts))
