"""Near-duplicate suppression over a stream, with the last kept time per fingerprint as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailspark.functions import scalars as S
from trailspark.operators.timeline import fingerprint


def deduplicate_stream(events: DataFrame, window_seconds: float = 2.0, retention: str = "1 hour") -> DataFrame:
    """The events a batch run would keep, provided they arrive in order per fingerprint. State of a fingerprint
    is dropped ``retention`` of processing time after its last batch. Spark then runs batches without data to
    expire state; a bounded run (availableNow) ends only with ``spark.sql.streaming.noDataMicroBatches.enabled`` off."""
    rows = events.withColumn("_fp", fingerprint()).withColumn("_us", F.unix_micros(S.iso_timestamp(F.col("timestamp_utc"))))
    window = round(window_seconds * 1_000_000)
    hold = int(pd.Timedelta(retention).total_seconds() * 1000)

    def keep(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, no_time = state.get if state.exists else (None, False)
        for pdf in batches:
            pdf, out = pdf.sort_values("_us", na_position="last", kind="stable"), []
            for i, us in enumerate(pdf["_us"]):
                if pd.isna(us):
                    fresh, no_time = not no_time, True
                else:
                    fresh = last is None or us - last > window
                    last = int(us) if fresh else last
                if fresh:
                    out.append(i)
            yield pdf.iloc[out].drop(columns=["_fp", "_us"])
        state.update((last, no_time))
        state.setTimeoutDuration(hold)

    return rows.groupBy("_fp").applyInPandasWithState(keep, events.schema, "last long, no_time boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
