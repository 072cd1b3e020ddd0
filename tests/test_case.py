"""A whole case from files on disk, with hand-derived expectations."""

import json
import sqlite3
import zipfile

import pytest

from trailspark.plans.engine import Engine

CODEX = [
    {"timestamp": "2026-01-02T03:04:05Z", "type": "response_item", "payload": {"type": "message", "role": "user", "thread_id": "t1", "content": [{"type": "input_text", "text": "hello"}]}},
    {"timestamp": "2026-01-02T03:04:06Z", "type": "response_item", "payload": {"type": "message", "role": "user", "thread_id": "t1", "content": [{"type": "input_text", "text": "<environment_context>x</environment_context>"}]}},
    {"timestamp": "2026-01-02T03:04:07Z", "type": "response_item", "payload": {"type": "message", "role": "assistant", "thread_id": "t1", "content": [{"type": "output_text", "text": "Hi, how can I help you today?"}]}},
    {"timestamp": "2026-01-02T03:04:08Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 10, "output_tokens": 4}}}},
]
GEMINI = [
    {"created_at": "2026-01-02T04:00:00Z", "step_index": 1, "source": "USER_EXPLICIT", "type": "USER_INPUT", "content": "<USER_REQUEST>list files</USER_REQUEST>"},
    {"created_at": "2026-01-02T04:00:01Z", "step_index": 2, "source": "MODEL", "type": "PLANNER_RESPONSE", "content": "I will list them.", "thinking": "plan",
     "tool_calls": [{"name": "run_command", "args": {"CommandLine": "ls", "Cwd": "/home/a/p"}}, {"name": "write_to_file", "args": {"TargetFile": "/home/a/p/x.py", "CodeContent": "abc"}}]},
]


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    root = tmp_path_factory.mktemp("home")
    s = root / ".codex/sessions/2026"
    s.mkdir(parents=True)
    (s / "a.jsonl").write_text("\n".join(map(json.dumps, CODEX)) + "\nnot json\n")
    g = root / ".gemini/antigravity-cli/brain/S1/.system_generated/logs"
    g.mkdir(parents=True)
    (g / "transcript_full.jsonl").write_text("\n".join(map(json.dumps, GEMINI)) + "\n")
    c = root / ".claude"
    c.mkdir()
    (c / "h.json").write_text(json.dumps({"session_id": "s9", "messages": [{"role": "user", "content": "q"}, {"role": "model", "content": "a"}]}))
    (c / "skip.jsonl").write_text("{}\n")
    db = sqlite3.connect(root / ".codex/logs.sqlite")
    db.execute("CREATE TABLE logs (id INTEGER, ts INTEGER, level TEXT, feedback_log_body TEXT)")
    db.executemany("INSERT INTO logs VALUES (?,?,?,?)", [(1, 1700000000, "INFO", "plain row"), (2, 1700000000000, "ERROR", 'UserInput { text: "hi there", x }'), (3, None, "INFO", "")])
    db.commit()
    db.close()
    (c / "cut.json").write_text('{"role": "user", "content": "never clo')
    (root / ".codex/torn.sqlite").write_bytes(b"no database at all")
    for name, member in (("more.zip", "b.jsonl"), ("home/.codex/sessions/inside.zip", "never.jsonl")):  # an input, and a file in a folder
        at = root.parent / name if name == "more.zip" else root / ".codex/sessions/inside.zip"
        with zipfile.ZipFile(at, "w") as z:
            z.writestr(f"home/.codex/sessions/{member}", json.dumps(CODEX[0] | {"timestamp": "2026-01-03T00:00:00Z"}) + "\n")
    (root.parent / "bad.zip").write_bytes(b"PK but no archive")
    (root / "edr.csv").write_text("timestamp,message,event_type,user,computer,pid,destination_host\n2026-01-02T03:04:05Z,curl ran,ProcessEvent,al,h1,7,evil.example.com\n2026-01-02T03:04:06Z,net,ProcessRollup2,al,h1,7,127.0.0.1\n")
    return root


@pytest.fixture(scope="module")
def case(spark, home):
    return Engine(spark).analyze([str(home), str(home), *(str(home.parent / z) for z in ("more.zip", "bad.zip"))], [str(home / "edr.csv")])


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_events(case):
    got = rows(case.timeline.orderBy("event_number"), "agent", "event_type", "text")
    assert [g for g in got if g[0] == "codex" and g[2] == "input_text\nhello"]
    assert [t for a, t, _ in got if a == "gemini" and t != "USER PROMPT"].count("COMMAND") == 1
    kinds = sorted(t for a, t, _ in got if a == "gemini")
    assert kinds == ["ASSISTANT RESPONSE", "COMMAND", "FILE CHANGE", "SESSION", "USER PROMPT"]
    assert sorted(t for a, t, _ in got if a == "claude") == ["ASSISTANT RESPONSE", "USER PROMPT"]
    assert sorted(t for a, t, _ in got if a == "external") == ["EXTERNAL TELEMETRY", "NETWORK / API"]
    numbers = [r[0] for r in rows(case.timeline.orderBy("event_number"), "event_number")]
    assert numbers == list(range(1, len(numbers) + 1))


def test_gemini_details(case):
    r = case.timeline.where("agent = 'gemini' AND event_type = 'FILE CHANGE'").first()
    args = json.loads(r["details"])["args"]
    assert args["CodeContentLength"] == 3 and args["CodeContentSHA256"].startswith("ba7816bf") and r["target"] == "/home/a/p/x.py" and r["call_id"] == "2:1"
    assert case.timeline.where("event_type = 'COMMAND'").first()["commands"] == ["ls"]


def test_sqlite(case):
    got = rows(case.timeline.where("source_type = 'sqlite:logs'").orderBy("source_line"), "timestamp_utc", "event_type", "text")
    assert got == [("2023-11-14T22:13:20+00:00", "RUNTIME", ""), ("2023-11-14T22:13:20+00:00", "USER PROMPT", "hi there")]


def test_replay(case):
    assert [m for (m,) in rows(case.replay, "message")] == ["hello", "Hi, how can I help you today?", "list files", "I will list them."]


def test_indicators_and_tokens(case):
    assert ("domain", "evil.example.com", 1) in rows(case.indicators, "type", "value", "count")
    assert not [v for _, v, _ in rows(case.indicators, "type", "value", "count") if v.startswith("127.")]
    assert case.analytics["token_usage"].first().asDict() == {"input": 10, "output": 4}


def test_delta(case):
    got = rows(case.timeline.where("agent = 'external'").orderBy("event_number"), "delta_seconds", "session_key")
    assert got == [(None, "external:process:7"), (1.0, "external:process:7")]


def test_diagnostics(case, home):
    got = {f.rsplit("/", 1)[1]: (s, d) for f, s, d in rows(case.diagnostics, "file", "status", "detail")}
    assert got["a.jsonl"] == ("parsed", "codex-session: 4 events") and "skip.jsonl" not in got and got["edr.csv"][1] == "external_csv: 2 events"
    assert got["b.jsonl"] == ("parsed", "codex-session: 1 events") and "never.jsonl" not in got and "inside.zip" not in got
    assert got["bad.zip"][0] == "read-error" and got["bad.zip"][1]
    assert got["cut.json"] == ("parse-error", "multi-agent-json: not valid JSON") and got["torn.sqlite"] == ("parse-error", "sqlite: file is not a database")


def test_write(spark, case, tmp_path):
    doc = Engine(spark).write(case, str(tmp_path / "out"))
    names = {p.name for p in (tmp_path / "out").iterdir()}
    assert {"AI_Agent_Timeline.csv", "AI_Agent_Timeline.jsonl", "Case_Replay.csv", "Indicators.csv", "Indicators_STIX_2.1.json", "Analytics.json", "Ingestion_Diagnostics.csv", "AI_Agent_Report.html", "SHA256SUMS.txt"} <= names
    assert json.loads((tmp_path / "out/Indicators_STIX_2.1.json").read_text())["type"] == "bundle"
    assert (tmp_path / "out/AI_Agent_Timeline.csv").read_bytes()[:3] == b"\xef\xbb\xbf" and doc["total_events"] == case.timeline.count()
