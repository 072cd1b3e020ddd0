"""Row-local operators and order-dependent folds against hand-derived expectations and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from trailspark.functions import json_walk, repair
from trailspark.functions import scalars as S
from trailspark.operators import redact, replay, timeline


def one(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,masked", [("abcdefgh", "********"), ("abcdefghi", "abcd*fghi"), ("", "")])
def test_mask(spark, raw, masked):
    assert one(spark, S.mask_secret(F.col("v")), v=raw) == masked


def test_uuid5(spark):
    assert one(spark, S.uuid5(F.lit("domain:example.com"))) == "c9e5737a-2ccf-5366-9928-910d40c47aed"


@pytest.mark.parametrize("number,iso", [(1700000000000, "2023-11-14T22:13:20+00:00"), (1700000000.5, "2023-11-14T22:13:20.500000+00:00"), (1e18, "1.0E18")])
def test_epoch(spark, number, iso):
    assert one(spark, S.iso_epoch(F.lit(number))) == iso


def test_unix_time(spark):
    assert one(spark, S.unix_time(F.lit("1700000000"), F.lit("123456789"))) == "2023-11-14T22:13:20.1234567Z"


def test_half_even(spark):
    assert one(spark, timeline.half_even(F.lit(62500))) == 0.062


@pytest.mark.parametrize("times,kept", [([0, 2, 4], [0, 4]), ([0, 1, 2, 3, 4, 5], [0, 3]), ([0, None, None], [0, None]), ([None, None], [None])])
def test_greedy_cases(spark, times, kept):
    rows = [("k", None if t is None else t * 1_000_000, i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, us long, i int")
    got = sorted((r["us"] is None, r["us"]) for r in timeline.greedy_keep(df, ["k"], "us", ["i"], 2_000_000).collect())
    assert got == sorted((t is None, None if t is None else t * 1_000_000) for t in kept)


def test_greedy_random(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(0, 400), i) for i in range(600)]
    last, want = {}, set()
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] > 5:
            last[k] = t
            want.add(i)
    got = timeline.greedy_keep(spark.createDataFrame(rows, "k string, us long, i int"), ["k"], "us", ["i"], 5)
    assert {r["i"] for r in got.collect()} == want


def test_numbers_are_a_permutation(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("v")).repartition(7)
    got = timeline.global_number(df, [F.col("v").asc()], "n").orderBy("n").collect()
    assert [(r["v"], r["n"]) for r in got] == [(i, i + 1) for i in range(500)]


def test_redaction_in_turn(spark):
    r = one(spark, redact.redact(F.col("v")), v="token=ghp_abcdefghijklmnopqrstuvwx")
    assert r["text"][:4] == "toke" and r["text"].endswith("uvwx")
    assert [f["type"] for f in r["findings"]] == ["GitHub Token", "Generic Credential"] and len(r["text"]) == 34


def test_redaction_keeps_length(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["token=", "AKIA", "ghp_", "ABCD", "0123456789", "abcdefghijklmnopqrst", " ", "-", "x"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "v string").select("v", redact.redact(F.col("v"))["text"].alias("r"))
    assert all(len(r["v"]) == len(r["r"]) for r in df.collect())


def test_walks():
    doc = {"a": {"role": "", "x": [1, True, None, {"image": "no", "t": "yes"}]}, "b": {"role": "User"}}
    assert json_walk.leaf_text(doc) == "\n1\nTrue\nyes\nUser"
    near = lambda d, *keys: json_walk.pick(json_walk.nearest(d, frozenset(keys)), keys)
    assert near(doc, "role") == "User" and near({"n": 0}, "n") == 0 and near({"n": False}, "n") is False and near({}, "n") is None
    # Depth counts before document order, then document order before the order of the keys.
    assert near({"x": {"y": {"k": 1}}, "z": {"k": 2}}, "k") == 2 and near({"x": [{"j": 3}], "z": [{"k": 2}]}, "k", "j") == 3 and near({"K": 5}, "k") == 5
    assert json_walk.said({"role": "User", "content": [{"type": "input_text", "text": "hi"}]}) == ("user", "input_text\nhi")
    assert json_walk.said({"text": " ", "payload": {"content": "c"}}) == ("", "c") and json_walk.said([1]) == ("", "")
    deep = "[" * 100_000 + "]" * 100_000
    assert json_walk.parsed(deep) == (False, None)


@pytest.mark.parametrize("raw,iso", [('{"ts": 1700000000000}', "2023-11-14T22:13:20+00:00"), ('{"ts": true}', "1970-01-01T00:00:01+00:00"), ('{"ts": "1700000000"}', "1700000000"), ('{"ts": 1700000000000000000}', "1700000000000000000"), ("{}", "")])
def test_record_times(spark, raw, iso):
    df = spark.createDataFrame([(raw,)], "v string").select(json_walk.record(F.col("v"), {}, payload=False).alias("r"))
    assert df.select(json_walk.time_of("r").alias("t")).first()["t"] == iso


@pytest.mark.parametrize("raw,meant", [("cafÃ©", "café"), ("itâ€™s", "it’s"), ("plain Ã", "plain Ã"), ("", ""), ("Ã© 日", "Ã© 日"), ("Â\u0080", "\u0080")])
def test_mojibake(spark, raw, meant):
    assert one(spark, repair.mojibake_repaired(F.col("v")), v=raw) == meant


@pytest.mark.parametrize("raw,meant", [("input_text\nA &amp; B\\n\\n\\n\\nC", "A & B\n\nC"), ("a\\u00e9b\\ud83d\\ude00 \\ud83d.", "aéb😀 �."), ("x \t\n\t y\r\nz\u2028w", "x\ny\nz\nw"), ("&lt;b&gt; \\\"q\\\"", '<b> "q"'), (None, ""), ("\0a", "a")])
def test_normalized(spark, raw, meant):
    assert one(spark, repair.normalized(F.col("v")), v=raw) == meant


@pytest.mark.parametrize("raw,meant", [("It’s “A” — B", "its a - b"), ("\\\\\\2315; x", "\\2315; x"), ("A  \n b", "a b"), ("`c`", "c")])
def test_folded(spark, raw, meant):
    assert one(spark, repair.folded(F.col("v")), v=raw) == meant


def test_begins():
    assert repair.begins("a" * 25, "a" * 25 + " n") and not repair.begins("a" * 25, "a" * 25 + " tail") and not repair.begins("ab", "abc")


def talk(spark, rows):
    cols = "event_number int, timestamp_utc string, session_key string, agent string, event_type string, source_type string, conversation_eligible boolean, role string, text string, summary string, action string, source_file string"
    data = [(i, t, "s", "codex", "USER PROMPT" if r == "user" else "ASSISTANT RESPONSE", "codex_session_jsonl", True, r, m, "", "", "f.jsonl") for i, (t, r, m) in enumerate(rows, 1)]
    return [r["message"] for r in replay.build_replay(spark.createDataFrame(data, cols)).collect()]


def test_replay_copies(spark):
    base = "2026-01-02T03:04:%02dZ"
    rows = [(base % 1, "user", "yes"), (base % 2, "user", "Yes"), (base % 3, "assistant", "Here is a long enough answer."), (base % 4, "assistant", "Here is a long enough answer. n"), (base % 30, "assistant", "Here is a long enough answer. n"),
            (base % 31, "user", "<permissions x"), (base % 32, "assistant", "jsonrpc call")]
    assert talk(spark, rows) == ["yes", "Here is a long enough answer.", "Here is a long enough answer. n"]


def test_replay_in_pieces(spark):
    """Pieces walked together accept what one walk over all messages accepts."""
    rng = random.Random(5)
    long = "Here is one long enough answer for all"
    says = ["yes", "no", "go on", "stop it", *[long + t for t in ("", " n", " no", " not")], *[f"line {i} is fine" for i in range(12)]]
    at = sorted(rng.randrange(0, 400) for _ in range(150))
    rows = [(f"2026-01-02T03:{4 + t // 60:02d}:{t % 60:02d}Z", rng.choice(["user", "assistant"]), rng.choice(says)) for t in at] + [("", "user", rng.choice(says)) for _ in range(40)]
    cols = "event_number int, timestamp_utc string, session_key string, agent string, event_type string, source_type string, conversation_eligible boolean, role string, text string, summary string, action string, source_file string"
    data = [(i, t, "s", "codex", "USER PROMPT" if r == "user" else "ASSISTANT RESPONSE", "codex_session_jsonl", True, r, m, "", "", "f.jsonl") for i, (t, r, m) in enumerate(rows, 1)]
    want, seen = [], set()
    for i, (t, r, m) in enumerate(rows, 1):
        us = int(t[14:16]) * 60 + int(t[17:19]) if t else None
        echo = False
        for _, s, p, q in [w for w in want[-8:][::-1] if w[2] == r]:
            if us is not None and s is not None and us - s > 15:
                break
            a, b = sorted((m, q), key=len)
            echo |= a == b or len(a) >= 20 and b.startswith(a) and len(b[len(a) :].strip()) <= 3
        if (r, m) not in seen and not echo:
            seen.add((r, m))
            want.append((i, us, r, m))
    for size in (50, 1000):
        got = replay.build_replay(spark.createDataFrame(data, cols), size).collect()
        assert [x["event_number"] for x in got] == [w[0] for w in want], size
    assert replay.build_replay(spark.createDataFrame([], cols)).count() == 0


def test_stretches(spark, monkeypatch):
    """Stretches over many chunks of slots are those of the gaps between neighbours."""
    monkeypatch.setattr(timeline, "SLOTS", 4)
    rng = random.Random(3)
    rows = [(k, rng.randrange(-400, 400)) for k in ("a", "b", "c") for _ in range({"a": 8, "b": 60, "c": 600}[k])]
    got = timeline.stretches(spark.createDataFrame(rows, "k string, us long"), "k", "us", 5).collect()
    assert sorted((r["k"], r["us"]) for r in got) == sorted(rows)
    slots = {(k, us // 5) for k, us in rows}
    for r in got:
        s = r["us"] // 5
        while (r["k"], s - 1) in slots:
            s -= 1
        assert r["_stretch"] == s


def test_stream(spark, tmp_path):
    from trailspark.operators.events import conform
    from trailspark.streaming.dedupe import deduplicate_stream

    rows = [(f"2026-01-02T03:04:0{s}Z", "Prompt", "UserInput", "hi") for s in (0, 2, 4)] + [("", "Prompt", "UserInput", "hi")] * 2
    conform(spark.createDataFrame(rows, "timestamp_utc string, category string, action string, text string")).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    src = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = deduplicate_stream(src).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    assert sorted(r["timestamp_utc"] for r in spark.table("kept").collect()) == ["", "2026-01-02T03:04:00Z", "2026-01-02T03:04:04Z"]


def regex_count(column):
    """How many pattern expressions a column evaluates for a row, as its plan has them."""
    return str(column).lower().count("regexp_") + str(column).count("RLIKE")


@pytest.mark.parametrize("raw,iso", [
    (" 2024-02-29T03:04:05,1234567Z ", "2024-02-29T03:04:05.123456+00:00"), ("20240102T0304+0230", "2024-01-02T00:34:00+00:00"), ("2024-01-02 03-05", "2024-01-02T08:00:00+00:00"), ("2024-01-02T03:04:05.100", "2024-01-02T03:04:05.100000+00:00"),
    ("20240102", "2024-01-02T00:00:00+00:00"), ("20240102030405", "20240102030405"), ("#20240102|Z", "#20240102|Z"), ("2023-02-29", "2023-02-29"), ("2024-01-02Z", "2024-01-02Z"), (" x ", "x"), (None, "")])
def test_iso_in_one_match(spark, raw, iso):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(S.iso_utc(F.col("v")).alias("x")).first()["x"] == iso
    assert regex_count(S.iso_utc(F.col("v"))) == 1  # one match for a time, however many parts it has


@pytest.mark.parametrize("raw,day,shown", [("2024-01-02T23:30:00-01:00", "2024-01-03", "00:30:00 UTC"), ("2024-01-02 at noon", "2024-01-02", "2024-01-02 at noon"), ("", "unknown", "Time unavailable")])
def test_days_in_one_match(spark, raw, day, shown):
    df = spark.createDataFrame([(raw,)], "v string").select(S.replay_date(F.col("v")).alias("d"), S.replay_time(F.col("v")).alias("t"))
    assert tuple(df.first()) == (day, shown)
    assert regex_count(S.replay_date(F.col("v"))) == regex_count(S.replay_time(F.col("v"))) == regex_count(S.timeline_time(F.col("v"))) == 1


def test_paths_in_few_patterns(spark):
    """Paths by trust, without case behind a drive letter; patterns run a few times a text, not once a use of their result."""
    from trailspark.operators import paths

    text = r"<path> /home/a/x.py </path> see c:\A\b\c.txt, C:\a\b\C.TXT and /opt/one/two.c; https://h.com/home/x/y /home/path/z <b>/tmp/q"
    df = spark.createDataFrame([(text, "/srv/w/d", "'/etc/passwd',"), (text, "", "no path"), ("", "", "")], "t string, c string, g string")
    e = paths.extract_paths(F.col("t"), F.col("c"), F.col("g"), F.lit(True))
    found = ["/home/a/x.py", r"c:\A\b\c.txt", "/opt/one/two.c", "/tmp/q"]
    assert [r["p"] for r in df.select(e.alias("p")).collect()] == [["/srv/w/d", "/etc/passwd", *found], found, []]
    assert regex_count(e) <= 10


def test_replay_rounds_do_not_grow_with_pieces(spark, monkeypatch):
    """Pieces that accept nothing hand on the last messages of the pieces before them in one round."""
    cols = "event_number int, timestamp_utc string, session_key string, agent string, event_type string, source_type string, conversation_eligible boolean, role string, text string, summary string, action string, source_file string"
    says = [f"line {i} is fine" for i in range(4)] * 8 + ["line 3 is fine, and more is said", "line 3 is fine, and more is said n"]
    data = [(i, "", "s", "codex", "USER PROMPT", "codex_session_jsonl", True, "user", m, "", "", "f.jsonl") for i, m in enumerate(says, 1)]
    rounds, write = [], replay.tables.materialise
    monkeypatch.setattr(replay.tables, "materialise", lambda df, tag: (rounds.append(tag), write(df, tag))[1])
    got = replay.build_replay(spark.createDataFrame(data, cols), 4).collect()
    assert [r["event_number"] for r in got] == [1, 2, 3, 4, 33] and rounds.count("replay") <= 4


def test_summary_collapsed_once(spark):
    from trailspark.operators import events

    df = spark.createDataFrame([("a \n b" * 200, "", "", "", "x"), (" \t", "d", "", "", "x"), (None, None, None, "act", "x")], "text string, details string, target string, action string, event_type string")
    assert [r["s"] for r in df.select(events.summary().alias("s")).collect()] == [("a b" * 200)[:300] + "…", "", "act"]
    assert regex_count(events.summary()) == 1
