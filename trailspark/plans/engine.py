"""The analysis plan: from artifact files and telemetry to timeline, indicators, replay and rollups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from trailspark.operators import analytics, events, indicators, replay, timeline
from trailspark.sinks import outputs
from trailspark.sources import external_csv, files


@dataclass
class Case:
    """Named results of one analysis, lazy but for the cached timeline."""

    timeline: DataFrame
    indicators: DataFrame
    replay: DataFrame
    analytics: dict[str, DataFrame]
    diagnostics: DataFrame


class Engine:
    """``Engine(spark).analyze(inputs)``; ``adapters`` may be extended with further input formats."""

    def __init__(self, spark: SparkSession, adapters: tuple[files.Adapter, ...] = files.ADAPTERS):
        self.spark, self.adapters = spark, adapters
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def analyze_events(self, raw: DataFrame, diagnostics: DataFrame | None = None, keep_duplicates: bool = False, dedupe_window: float = 2.0) -> Case:
        """Events in the event schema: suppress near copies, enrich, number, then three consumers of one cached timeline."""
        kept = raw if keep_duplicates else timeline.deduplicate(raw, dedupe_window)
        numbered = timeline.number_events(events.enrich(kept)).persist()
        empty = self.spark.createDataFrame([], "file string, status string, detail string")
        return Case(numbered, indicators.extract_iocs(numbered), replay.build_replay(numbered), analytics.analytics(numbered), diagnostics if diagnostics is not None else empty)

    def analyze(self, inputs: list[str], csvs: list[str] | None = None, keep_duplicates: bool = False, dedupe_window: float = 2.0) -> Case:
        parts, notes = [], []
        if inputs:
            found, diagnostics = files.ingest(files.read_files(self.spark, *inputs), self.adapters)
            parts.append(found)
            notes.append(diagnostics)
        for path in csvs or []:
            rows = external_csv.import_csv(self.spark, path)
            parts.append(rows)
            notes.append(rows.selectExpr("1 AS x").groupBy().count().selectExpr(f"'{path}' AS file", "'parsed' AS status", "concat('external_csv: ', count, ' events') AS detail"))
        diagnostics = notes[0]
        for n in notes[1:]:
            diagnostics = diagnostics.unionByName(n)
        return self.analyze_events(external_csv.union_events(*parts), diagnostics, keep_duplicates, dedupe_window)

    def write(self, case: Case, output: str, redact_metadata: bool = True) -> dict | None:
        """The case folder; without any event only the diagnostics are written and None comes back."""
        if not case.timeline.limit(1).count():
            outputs.write_diagnostics(output, case.diagnostics)
            return None
        return outputs.write_case(output, case.timeline, case.replay, case.indicators, case.analytics, case.diagnostics, redact_metadata)

    def collect(self, home: str, output: str) -> DataFrame:
        """The manifest of agent artifacts under a home folder, written as CSV and zipped."""
        found = files.manifest(files.read_files(self.spark, home))
        from pathlib import Path

        Path(output).mkdir(parents=True, exist_ok=True)
        outputs.write_csv(found, Path(output) / "Collection_Manifest.csv", ["agent", "source", "destination", "size", "sha256", "error"])
        outputs.zip_folder(output, output.rstrip("/") + ".zip")
        return found
