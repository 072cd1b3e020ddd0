"""Conversation replay: eligible messages, cleaned, without copies."""

from __future__ import annotations

from collections import deque
from itertools import groupby, takewhile
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark import tables
from trailspark.functions import repair
from trailspark.functions import scalars as S
from trailspark.operators import timeline

SOURCES, ROLES = ("codex_session_jsonl", "gemini_antigravity_jsonl"), ("user", "human", "assistant", "ai")
CONTEXTS = ("<environment_context>", "<recommended_plugins>", "<permissions", "<workspace")
#: Signs of runtime output in a message.
RUNTIME_MARKS = (
    "start_server_task", "session_loop[", "submission_dispatch(", "jsonrpc", "jsonrpcresponse", "peermessage(", "listtoolsresult", "listtoolresult", "otel.name", "codex.op=", "thread_id=",
    "submission_id=", "mcp_server", "initialize:serve_inner", "response(jsonrpc", "toolresult", "toolcall", "function_call", "functioncall")
STRUCTURE = ("{", "}", "[", "]", "::", "=", "(", ")", "jsonrpc", "result:")
LOOK_BACK, WINDOW_US = 8, 15_000_000
#: Messages that one task walks in order, and what its rows are: fingerprints accepted before, the last messages accepted before, its own.
PIECE_ROWS = 50_000
TAKEN, TAIL, SAID = range(3)


class Said(NamedTuple):
    piece: int
    kind: int
    at: int
    print: str
    label: str | None
    folded: str | None
    even: str | None
    us: int | None



def count_of(c: Column, word: str) -> Column:
    return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def is_clean_response(message: Column, action: Column) -> Column:
    """Whether an assistant's message reads as prose rather than as a protocol or object dump."""
    return S.let(S.strip(message), lambda v: S.let(F.struct(v.alias("v"), F.lower(v).alias("low")), lambda x: ~_is_dump(x["v"], x["low"], action)))


def _is_dump(v: Column, low: Column, action: Column) -> Column:
    runtime = S.has_any(F.lower(S.text(action)), ("runtime", "tool", "sessionevent", "sqlite"))
    seen = F.struct(
        sum((count_of(low, t) for t in STRUCTURE[1:]), count_of(low, STRUCTURE[0])).alias("structure"), F.regexp_count(v, F.lit("[A-Za-z][A-Za-z'-]*")).alias("words"),
        F.regexp_count(v, F.lit(r"[.!?](?:(?U:\s)|$)")).alias("sentences"), F.regexp_count(v, F.lit("[A-Za-z_][A-Za-z0-9_.:-]{12,}")).alias("long_names"))
    heavy = lambda n: ((n["structure"] >= 10) & (n["sentences"] == 0)) | ((n["structure"] >= 16) & (n["words"] < 40)) | (runtime & (n["structure"] >= 5)) | ((n["words"] < 5) & (n["long_names"] >= 2))
    return (v == "") | S.has_any(low, RUNTIME_MARKS) | S.let(seen, heavy)


def source_priority() -> Column:
    kind, file = F.lower(S.text("source_type")), F.lower(S.text("source_file"))
    return F.when(kind.contains("session_jsonl") | file.rlike(r"\.(jsonl|ndjson)$"), 0).when(kind.startswith("sqlite:") | file.rlike(r"\.(sqlite|sqlite3|db)$"), 1).otherwise(2)


def candidates(events: DataFrame) -> DataFrame:
    """Eligible messages of numbered events with their normalised text, role label and compared form."""
    df = events.where(
        F.col("event_type").isin("USER PROMPT", "ASSISTANT RESPONSE") & F.lower(S.text("source_type")).isin(*SOURCES)
        & F.coalesce("conversation_eligible", F.lit(False)) & F.lower(S.text("role")).isin(*ROLES))
    df = df.withColumn("message", repair.normalized(S.strip(S.first_text(S.text("text"), S.text("summary"))))).withColumn("folded", repair.folded(F.col("message")))
    # Written before they are filtered and ranged: a filter on the message would repeat its repair for every use in the
    # conditions, and choosing the ranges would repeat all of it.
    df = tables.materialise(df, "messages")
    starts = F.lit(False)
    for c in CONTEXTS:
        starts = starts | F.col("message").startswith(c)
    df = df.where((F.col("message") != "") & ~starts & ((F.col("event_type") != "ASSISTANT RESPONSE") | is_clean_response(F.col("message"), F.col("action"))))
    df = df.withColumn("label", F.when(F.lower("role").isin("user", "human"), "user").otherwise("agent"))
    df = df.withColumn("even", repair.even_depth(F.col("folded")))
    return df.withColumn("us", F.unix_micros(S.iso_timestamp(F.col("timestamp_utc"))))


def first_of_fingerprint(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each fingerprint over the whole case, as an aggregate with map-side combine."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("_f")).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in cols])


def build_replay(events: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """timestamp_utc, event_number, session_key, agent, role, event_type, message in replay order.

    A message goes if its fingerprint was accepted before or one of the last accepted ones echoes it, so what
    is accepted depends on all that came before. The ordered messages are cut into pieces that are walked at the same time,
    each given the fingerprints accepted in earlier pieces and the last messages accepted before it, in whichever pieces these
    lie, as the round before knew them. After n rounds the first n pieces are settled; rounds end when nothing changes, mostly
    after two or three.
    """
    cols = ["timestamp_utc", "event_number", "session_key", "agent", "label", "event_type", "message", "folded", "even", "us"]
    order = [F.col("us").asc_nulls_last(), F.col("prio").asc(), F.col("event_number").asc()]
    rows = timeline.global_number(candidates(events).withColumn("prio", source_priority()).select(*cols, "prio"), order, "_at")
    piece = F.expr(f"(_at - 1) div {piece_rows}L")
    said = rows.select(piece.alias("piece"), F.lit(SAID).alias("kind"), F.col("_at").alias("at"), F.sha2(F.concat("label", F.lit("|"), "folded"), 256).alias("print"), "label", "folded", "even", "us")
    feed, state, pieces = said, None, None
    while True:
        before = got if pieces is not None else None
        got = tables.materialise(feed.repartition("piece").sortWithinPartitions("piece", "kind", "at").mapInArrow(walk, said.schema), "replay")
        if before is not None:
            tables.drop_table(before)
        last_state, state = state, got.where(F.col("kind") == SAID).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("piece", "at").cast("decimal(38,0)")).alias("s"), F.max("piece").alias("last")).first()
        pieces = state["last"] if pieces is None else pieces
        if not pieces or state[:2] == last_state:
            break
        state = state[:2]
        firsts = got.where(F.col("kind") == SAID).groupBy("print").agg(F.min("piece").alias("first"))
        taken = said.select("piece", "print").distinct().join(firsts, "print").where("first < piece").select("piece", F.lit(TAKEN).alias("kind"), "print")
        # A message is among the last accepted ones up to the piece of the eighth after it; eight a piece are looked at.
        until = F.coalesce(F.lead("piece", LOOK_BACK).over(Window.orderBy("at")), F.lit(pieces))
        tails = got.where(F.col("kind") == TAIL).withColumn("_to", until).where("_to > piece").withColumn("piece", F.explode(F.expr("sequence(piece + 1, _to)"))).drop("_to")
        feed = said.unionByName(taken, allowMissingColumns=True).unionByName(tails)
    accepted = got.where(F.col("kind") == SAID).select(F.col("at").alias("_at"))
    return rows.join(accepted, "_at", "left_semi").orderBy("_at").select(
        "timestamp_utc", "event_number", "session_key", S.first_text(S.text("agent"), F.lit("unknown")).alias("agent"), F.col("label").alias("role"), "event_type", "message")


def walk(batches):
    """Rows by piece, kind and place: of each piece the accepted messages (without texts) and the last ones it accepted itself."""

    def rows():
        for batch in batches:
            yield from map(Said._make, zip(*(batch.column(c).to_pylist() for c in Said._fields)))

    def packed(out: list[Said]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], list(Said._fields))

    for _, piece in groupby(rows(), key=lambda r: r.piece):
        known, recent, out = set(), deque(maxlen=LOOK_BACK), []
        for row in piece:
            if row.kind == TAKEN:
                known.add(row.print)
            elif row.kind == TAIL:
                recent.appendleft(row)
            elif row.print not in known and not echoed(row, recent):
                known.add(row.print)
                recent.appendleft(row)
                out.append(row._replace(label=None, folded=None, even=None, us=None))
        yield packed(out + [r._replace(kind=TAIL) for r in reversed(recent) if r.kind == SAID])


def echoed(row: Said, recent) -> bool:
    """Whether a message repeats one of the same role among the ``recent`` ones, the latest first, up to the first that is
    too far off in time; without a time nothing is too far off."""
    far = lambda r: None not in (row.us, r.us) and abs(row.us - r.us) > WINDOW_US
    near = takewhile(lambda r: not far(r), (r for r in recent if r.label == row.label))
    return any(row.folded == r.folded or (row.folded and r.folded and (row.even == r.even or repair.begins(row.folded, r.folded))) for r in near)


def by_day(replay: DataFrame) -> DataFrame:
    return replay.groupBy(S.replay_date(F.col("timestamp_utc")).alias("day")).agg(F.count(F.lit(1)).alias("messages"))
