"""Each corpus operator against brute force and on hard rows: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailspark.llm import chat_format, decontaminate, exact_dedup, html_extract, line_dedup, minhash, mixing, sharding, shingles, token_output, toxicity

SCHEMA = "doc_id long, text string, source string, _id string, size int, _crc int, _t string"


def table(spark, rows):
    """Documents with columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, s, "x", 1, 2, "y") for i, t, s in rows], SCHEMA).repartition(3)


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(i, words(rng, rng.randrange(1, 120)), rng.choice(["hot"] * 4 + ["a", "b", None])) for i in range(120)]
    base = words(rng, 90, 5000)
    for i in range(120, 150):  # near copies of one text
        w = base.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append((i, " ".join(w), "hot"))
    out += [(150, None, "a"), (151, "", None), (152, "  \t\n", "a"), (153, "Same Text", "b"), (154, "same text", "b"), (155, words(rng, 30_000), "hot"), (5, out[5][1], out[5][2]), (156, "İé one two", "c")]
    return out


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_exact_dedup(spark, rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    want = Counter((i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, _ in rows)
    assert Counter(map(tuple, exact_dedup.exact_dedup(table(spark, rows), hash_all=True).collect())) == want
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def brute_components(rows, percent):
    sets = {i: shingles.shingle_set(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if len(a) and len(b):
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("percent,block", [(85, 1000), (80, 7)])
def test_minhash(spark, rows, percent, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)  # small blocks cut the cluster over many tasks
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table(spark, rows), percent=percent).collect()}
    assert got == brute_components(rows, percent)


def test_minhash_empty(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_bayes_bounds_keep_threshold_pairs():
    assert all(0 < m < n for n, m in minhash.bayes_bounds(85, 1e-6, 120))
    assert (1 - 0.85**5) ** minhash.bands_for(85, 1e-6) <= 1e-6


def test_mixing(spark, rows):
    got = mixing.mix(table(spark, rows)).collect()
    again = mixing.mix(table(spark, rows).repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["copies"])
    assert Counter(map(key, got)) == Counter(map(key, again)) and len(got) == len(rows)
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    source = {i: s for i, t, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["size"] * r["copies"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert 0 <= r["copies"] <= 3
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 and target[s] <= 3 * sizes[s] + 1e-6
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert mixing.mix(table(spark, [])).count() == 0


def test_targets_reshare():
    t = mixing.fill_targets([("a", 100), ("b", 1), ("c", 1), (None, 0)])
    assert t["b"] == 3 and t["c"] == 3 and t[None] == 0 and abs(t["a"] - 96) < 1e-9


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 50, 40).astype(float), rng.random(40)
    runs = np.array([mixing.pivot(size, p, rng.random(40)) for _ in range(3000)])
    assert np.allclose(runs @ size, size @ p, atol=1e-4)
    assert ((runs > 1e-6) & (runs < 1 - 1e-6)).sum(1).max() <= 1
    assert np.abs(runs.mean(0) - p).max() < 0.05


def test_mix_documents(spark, rows):
    docs = table(spark, rows)
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == +copies and all((r["_crc"], r["size"]) == (2, 1) for r in got)


@pytest.mark.parametrize("bucket", [5000, 16])
def test_sharding(spark, rows, bucket, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    got = sharding.shard_rows(table(spark, rows), carry=["source"]).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by, mix = defaultdict(list), defaultdict(Counter)
    for r in got:
        by[r["shard"]].append(r["slot"])
        mix[r["source"]][r["shard"]] += 1
    assert sorted(by) == list(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for s, c in mix.items():
        assert max(c.values()) - min(c[k] for k in range(16)) <= 2
    assert sharding.shard_rows(table(spark, [])).count() == 0 and sharding.shard_rows(table(spark, rows[:3])).count() == 3


def brute_lines(rows, w):
    docs = {i: [(n, x) for n, x in enumerate((t or "").split("\n")) if x.split()] for i, t in sorted(rows)}
    first, out = {}, {}
    for i, lines in docs.items():
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[a:b])
                if sum(len(x.split()) for x in run) >= w and run not in first:
                    first[run] = (i, a)
    for i, lines in docs.items():
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[a:b])
                if run in first and first[run] < (i, a):
                    gone.update(n for n, _ in lines[a:b])
        out[i] = "\n".join(x for n, x in enumerate((dict(rows)[i] or "").split("\n")) if n not in gone)
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = ["a b c", "d", "e f", "", "g h i j", "k l", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(40)] + [(40, None), (41, ""), (42, "\n\n"), (43, "only one line of nine words is here now")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_lines int, _spans int")
    for w in (3, 6, 9):
        got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df, w).collect()}
        assert got == brute_lines(rows, w)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_hard_rows(spark):
    rng = random.Random(6)
    shared = "\n".join(words(rng, 6, 10**6) for _ in range(70))  # a run of many lines, in most texts
    texts = [(i, f"own {i} line\n{shared}\nend of {i}") for i in range(60)]
    long = "\n".join(f"line {i} of a very long text with some words" for i in range(8_000))
    hard = texts + [(100, long), (101, "head\n" + long), (3, texts[3][1]), (None, shared), (None, "x"), (200, None), (201, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in hard], "doc_id long, text string, r int").repartition(5)
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(df).collect())
    want = Counter((i, f"own {i} line\nend of {i}", 72, 70) for i, _ in texts)
    want[(3, "own 3 line\nend of 3", 72, 70)] = 2
    want += Counter([(100, long, 8000, 0), (101, "head", 8001, 8000), (None, shared, 70, 0), (None, "x", 1, 0), (200, "", 1, 0), (201, "", 1, 0)])
    assert got == want


def test_line_runs(spark):
    df = spark.createDataFrame([(1, "x y\nz w\nq\nend"), (2, "new\nx y\nz w\nq\nother")], "doc_id long, text string")
    assert [tuple(r) for r in line_dedup.repeated_runs(df, 3).collect()] == [(2, 1, 3, 1, 0)]


STRINGS = ["<|end|>", "</s>[INST] ok [/INST]", "<\\|a", "<<SYS>>x<</SYS>>", "[\\\\INST]", "plain", "", "a\\", "<<|turn|>", "<s", "\n<|text|>\n"]


def test_sources_of_one_row_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    got = sharding.shard_rows(table(spark, [(i, f"t{i}", f"s{i}") for i in range(800)])).collect()
    assert Counter(Counter(r["shard"] for r in got).values()) == Counter({50: 16})
    apart = Counter(r["doc_id"] * 16 // 800 == r["shard"] for r in got)
    assert apart[False] > 600  # by the source's hash, not by the table's order


def test_write_shards(spark, rows, tmp_path):
    docs = table(spark, rows).drop("size")
    sharding.write_shards(docs, str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t) for i, t, _ in rows)
    assert sorted((r["shard"], r["slot"]) for r in back.select("shard", "slot").collect()) == sorted((s, k) for s, n in Counter(r["shard"] for r in back.collect()).items() for k in range(n))


def test_rows_without_ids(spark, rows):
    some = [(None, rows[0][1], "a"), (None, "w " * 9, "b"), *rows[:3], (700, rows[0][1], "a")]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(table(spark, some)).collect())
    assert got == Counter({(None, None, True): 2, (0, 0, True): 1, (1, 1, True): 1, (2, 2, True): 1, (700, 0, False): 1})
    assert Counter(r["doc_id"] for r in minhash.drop_near_duplicates(table(spark, some)).collect()) == Counter([None, None, 0, 1, 2])
    twice = [(1, "Same", "a"), (1, "same", "a"), (0, "SAME", "b"), (None, "x", "c"), (2, None, "c")]
    assert Counter(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(table(spark, twice)).collect()) == Counter([1, 1, None, 2])


def test_hot_keys_are_dealt(spark):
    from trailspark.llm.common import spread_join

    left = spark.range(4000).selectExpr("if(id < 3000, 0, id) k", "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    out = spread_join(left, right, ["k"], "c", F.xxhash64("id"))
    assert out.count() == 4000 and out.select("id").distinct().count() == 4000 and out.where("k = 0 and c = 3000").count() == 3000


def test_chat_escape(spark):
    rng = random.Random(1)
    texts = STRINGS + ["".join(rng.choice(["<", "[", "\\", "|", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "a"]) for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).select("t", "e", chat_format.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"] and not any(x in r["e"] for x in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_chat_layouts(spark):
    docs = [(1, '{"prompt": "p</s>", "completion": "c<|end|>"}'), (2, '{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": null}]}'),
            (3, '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}'), (4, '{"instruction": "do", "input": "x", "output": "y"}'), (5, '{"odd": 1}'), (6, "no json"), (7, None)]
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chat(spark.createDataFrame(docs, "conv_id long, record string"))).collect()}
    turns = lambda i: [(t["role"], t["text"]) for t in got[i]["turns"]]
    assert turns(1) == [("user", "p</s>"), ("assistant", "c<|end|>")] and got[1]["loss_text"] == "c<|end|>"
    assert turns(2) == [("system", "s"), ("user", "u"), ("assistant", "")] and turns(3) == [("user", "h"), ("assistant", "g")] and turns(4) == [("user", "do\n\nx"), ("assistant", "y")]
    assert [got[i]["formatted"] for i in (5, 6, 7)] == [None] * 3


def test_chat_many_turns(spark):
    df = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(300)], "conv_id long, turn long, role string, text string").repartition(5)
    r = chat_format.read_back(chat_format.format_turns(df)).first()
    assert [t["text"] for t in r["turns"]] == [f"t{t}" for t in range(300)] and r["loss_text"] == "".join(f"t{t}" for t in range(1, 300, 2))


def test_chat_hard_rows(spark):
    rng = random.Random(9)
    data = [(c, t, r, x, "clash", 1) for c in (1, None) for t, r, x in [(None, "user", "first"), (None, None, None), (0, "assistant", None), (0, "assistant", "tie"), (0, "assistant", "tie"), (200, "user", "<|end|>" * 3), (70, "assistant", "late </s>"), (-5, "system", "")]]
    data += [(2, 7, "assistant", "x" * 60_000, "", 0)] + [(3, 5, "assistant", f"{i} same turn", "", 0) for i in range(500)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, s string, at int")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    for c in (1, None, 2, 3):
        want = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x, *_ in data if i == c))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for *_, r, x in want] and got[c]["n_turns"] == len(want)
        assert got[c]["loss_text"] == "".join(x for *_, r, x in want if r == "assistant")
    assert chat_format.format_turns(df.limit(0)).count() == 0


def test_tokens(spark, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok_path = str(public_tokenizers.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(tok_path)
    extra = [(200, "a b Σας ΟΔΟΣ don't 123 4٣ <|endoftext|>x é ﬁ", "s"), (201, "x\u0085y\x1cz\U0001f600", "s")]
    every = rows + extra
    token_output.write_tokens(table(spark, every), str(tmp_path / "t"), tok_path)
    got = token_output.read_tokens(spark, str(tmp_path / "t")).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in every}
    start = 0
    for r, i in zip(sorted(got, key=lambda r: r["start"]), sorted(i for i, _, _ in every)):
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(ids[i])) and np.frombuffer(r["ids"], "<u2").tolist() == ids[i]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[i], "<u4").tobytes())
        start += len(ids[i])
    assert token_output.read_document(spark, str(tmp_path / "t"), 153) == [ids[153]]


def test_tokens_hard_rows(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    every = [(None, "null id", "s"), (None, None, "s"), (3, "same", "s"), (3, "same", "s"), (3, "other text", "s"), (-1, " \n\t", "s"), (9, "x" * 5000 + " a-b--c\u00a0d ÉCOLE ß ŠÉ i̇ İ", "s")]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):  # by words, and whole texts
        path, where = str(public_tokenizers.path(name)), str(tmp_path / name)
        tok = Tokenizer.from_file(path)
        assert token_output.Encoder(path, 2, 2).words == (name[0] == "w")
        token_output.write_tokens(table(spark, every), where, path)
        got = Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u2").tolist())) for r in token_output.read_tokens(spark, where).collect())
        assert got == Counter((i, (*tok.encode(t or "", add_special_tokens=False).ids, 2)) for i, t, _ in every)
        token_output.write_tokens(table(spark, []), where + "0", path)
        assert token_output.read_tokens(spark, where + "0").count() == 0


def test_decontaminate(spark):
    rng = random.Random(2)
    item = "In 2019 Alice Smith sold 12 apples and 7 pears to the shop for 12 dollars while rain fell over green hills"
    again = "In 2021 Maria Jones sold 30 apples and 9 pears to the shop for 30 dollars while rain fell over green hills"
    broken = "In 2021 Maria Jones sold 30 apples and 9 pears to the shop for 31 dollars while rain fell over green hills"
    pad = lambda: words(rng, 40, 10**6)
    docs = [(1, f"{pad()} {item} {pad()}"), (2, f"{pad()} {again} {pad()}"), (3, f"{pad()} {item.upper()} {pad()}"), (4, pad()), (5, None), (6, ""), (7, "sold 12 apples and 7 pears"), (8, broken)]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(9, item), (10, "w1 w2"), (11, None), (None, item)], "item_id long, text string")
    for size in (32 << 20, 60):  # one block, and a pass per block
        got = {r["doc_id"]: r for r in decontaminate.contaminated(df, bench, block_bytes=size).collect()}
        assert set(got) == {1, 2, 3} and got[1]["verbatim"] and not got[2]["verbatim"] and got[1]["coverage"] == 1.0
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {4, 5, 6, 7, 8} == {r["doc_id"] for r in kept.collect()} and decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_decontaminate_other_languages_and_clashes(spark):
    item = "Le train de Paris à Lyon part à douze heures et roule pendant sept heures avant de freiner dans la plaine verte"
    again = "Le train de Nantes à Brest part à vingt heures et roule pendant neuf heures avant de freiner dans la plaine verte"
    merged = "Le train de Nantes à Brest part à neuf heures et roule pendant neuf heures avant de freiner dans la plaine verte"
    docs = [(1, item), (2, again), (3, merged), (3, merged), (None, again), (4, "x " * 30_000 + again), (5, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, id int")
    bench = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["verbatim"]) for r in decontaminate.contaminated(df, bench).collect())
    assert got == Counter([(1, 7, True), (2, 7, False), (None, 7, False), (4, 7, False)])
    assert Counter(r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()) == Counter([3, 3, 5])
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 == decontaminate.drop_contaminated(df.limit(0), bench).count()


def brute_contaminated(docs, items, window=8, coverage=0.5):
    """Word by word: every alignment of every item with every document, no hashes and no index; for copies without insertions."""
    out, read = set(), lambda t: [c for x in (t or "").split() if (c := decontaminate.canonical(x))]
    for i, text in docs:
        d = read(text)
        for k, item in items:
            w = read(item)
            n = min(window, len(w))
            for shift in range(-len(w) + 1, len(d)):
                hits = []
                for a in range(len(w) - n + 1 if w else 0):
                    if not 0 <= a + shift <= len(d) - n:
                        continue
                    here, there = d[a + shift : a + shift + n], w[a : a + n]
                    for form in range(3):
                        few = n >= 4 and 2 * sum(x[form % 2].startswith("\0") for x in there) <= n
                        if few == (form < 2) and [x[form] for x in here] == [x[form] for x in there]:
                            hits.append((a, {(x[form % 2], x[2], y[2]) for x, y in zip(there, here) if x[form % 2].startswith("\0")}))
                pairs = set().union(*(p for _, p in hits)) if hits else set()
                clash = len({(k, o) for k, o, _ in pairs}) < len(pairs) or len({(k, v) for k, _, v in pairs}) < len(pairs)
                good = {a + j for a, p in hits if not clash or all(o == v for _, o, v in p) for j in range(n)}
                if w and len(good) >= coverage * len(w) and good:
                    out.add((i, k))
    return out


def test_decontaminate_brute_force(spark):
    rng = random.Random(12)
    vocab = ["the", "sold", "green", "apples", "rain", "over", "hill", "Alice", "Bob", "Rome", "12", "7", "9", "km", "two", "hours", "5kg", "a"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, text(rng.choice([1, 2, 3, 5, 9, 14, 20]))) for k in range(12)]
    docs = []
    for i in range(80):
        body = list(rng.choice(items)[1])
        for _ in range(rng.randrange(3)):  # changed words of a copy
            body[rng.randrange(len(body))] = rng.choice(vocab)
        docs.append((i, " ".join([f"q{j}x" for j in range(rng.randrange(50))] + body + [f"r{j}x" for j in range(5)])))
    items = [(k, " ".join(w)) for k, w in items]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_contaminated(docs, items)


def test_decontaminate_slot_heavy(spark):
    items = ["What comes next: 2, 4, 8, 16, 32, 64, 128?", "Compute 12 + 7 - 3 : 4", "Sort the ten numbers in the list below upwards: " + " ".join(str(i * 37 % 101) for i in range(25)), "Name Zanzibar's capital", "12 34"]
    docs = [(i, f"some words before {t} and some after") for i, t in enumerate(items)]
    docs += [(10, "What comes next: 3, 5, 9, 17, 33, 65, 129?"), (11, "Compute 13 + 7 - 3 : 4"), (12, "12 words 34"), (13, "compute 12 apples")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (20, "..."), (21, "")], "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(len(items))} and all(r["verbatim"] and r["coverage"] == 1.0 for r in got)


def test_decontaminate_edited_copies_anywhere():
    item = [f"v{i}" for i in range(20)]
    index, vocab = decontaminate.Index([(1, " ".join(item))], 8), decontaminate.Vocabulary()
    for start in range(45):
        # Runs of eight, four and eight words, apart by an inserted word each.
        tokens, *forms = vocab.read(" ".join([f"p{i}" for i in range(start)] + item[:8] + ["x"] + item[8:12] + ["y"] + item[12:]))
        assert [j[2] for j in decontaminate.judge(tokens, index, index.hits(forms))] == [0.8], start
    twice = "In 2019 Alice sold 12 apples and 7 pears to the shop"
    index = decontaminate.Index([(1, twice)], 8)
    text = " ".join(f"In {2000 + k} Maria sold {k} apples and {k + 90} pears to the shop" for k in range(20, 60))
    tokens, *forms = vocab.read(text)
    # All but the first window, which has more slots than half.
    assert [j[2] for j in decontaminate.judge(tokens, index, index.hits(forms))] == [11 / 12]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header class="site-header"><a href="/">Site</a></header><div class="cookie-notice">We use cookies</div>
<nav><ul><li><a href=a>A</a></ul></nav><div id=main-wrap><div class=content><h1>Big &amp; title</h1><p>Para one has\n quite some  text to be read by people, and <a href=x>one link</a>.<p>Short.
<ul><li>item a<li>item b</ul><div class=ad>Buy</div><form>mail <input></form><p>Third para with many more words to be counted in the end, caf&eacute;.</div><div class=sidebar><a href=1>L1</a> <a href=2>L2</a></div>
<section id=comments><p>Great article, I really liked it a lot and will read it again soon</p></section></div><footer>c 2024</footer><script>var t='</p>'</script>"""


def test_html(spark):
    want = "Big & title\nPara one has quite some text to be read by people, and one link.\nShort.\nitem a\nitem b\nThird para with many more words to be counted in the end, café."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "just text"), (5, "u", "<p>a<p>b"), (6, "u", "<div>" * 5000 + "deep"), (None, "u", "<nav>x</nav>"), (1, "u", PAGE)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, n int")
    got = html_extract.extract_pages(df).collect()
    texts = Counter((r["page_id"], r["text"]) for r in got)
    assert texts == Counter({(1, want): 2, (2, ""): 1, (3, ""): 1, (4, "just text"): 1, (5, "a\nb"): 1, (6, "deep"): 1, (None, ""): 1}) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_html_density_decides():
    para = "<p>A paragraph of the article with quite some words in it, as <b>articles</b> have<br>them, and an end.</p>"
    noise = "<div>" + "".join(f"<div><a href=/{i}>Other page number {i}</a> <span>more</span></div>" for i in range(30)) + "</div>"
    page = f"<body><div>{noise}<div><div>{para * 4}<div>{para * 2}</div></div></div>{noise}</div></body>"
    got = html_extract.extract(page)  # nothing declares itself here
    assert got.count("A paragraph") == 6 and "Other page" not in got and "more" not in got
    root = html_extract.parse(page)
    assert html_extract.densest(html_extract._measure(root), root).items[0].tag == "p"


def test_html_density_against_brute_force():
    rng = random.Random(11)

    def build(depth):
        out = ""
        for _ in range(rng.randrange(1, 5)):
            tag = rng.choice(["div", "p", "a", "b", "section", "li"])
            inner = " ".join("word" * rng.randrange(1, 3) for _ in range(rng.randrange(0, 25)))
            out += f"<{tag}>{inner}{build(depth - 1) if depth and tag in ('div', 'section') else ''}</{tag}>" + rng.choice(["", "tail text "])
        return out

    def text(n, only=None):
        if only and n.tag == only:
            return text(n)
        return "".join(x if isinstance(x, str) else text(x, only) for x in n.items if only is None or not isinstance(x, str))

    def below(n):
        return [y for x in n.items if not isinstance(x, str) for y in (x, *below(x))]

    for _ in range(60):
        root = html_extract.parse(f"<body>{build(3)}</body>")
        order = html_extract._measure(root)
        size = lambda s: len("".join(s.split()))
        page_c, page_l = max(size(text(root)), 1), size(text(root, "a"))

        def density(n):
            c, t, lc, lt = size(text(n)), len(below(n)), size(text(n, "a")), sum(x.tag == "a" for x in below(n))
            return html_extract._density(c, t, lc, lt, page_c, page_l)

        block = lambda n: n.tag in html_extract.BLOCK or any(x.tag in html_extract.BLOCK for x in below(n))
        want = [sum(density(x) for x in n.items if not isinstance(x, str) and block(x)) for n in order]
        assert np.allclose(want, [n.total for n in order])


def test_html_hard_pages():
    import time

    began = time.process_time()
    for page, want in (("<article><header>" + "<div>" * 2000 + "deep</div>", "deep"), ("<a " * 20_000 + "x", None), ('<a href="' * 20_000 + ">", None), ("<textarea>" * 20_000, None), ("</b>" * 20_000 + "x", "x"),
                       ("<div class=comment>" * 2000 + "text", None), ("before <math>x</math> after", "before x after"), ("<p>it<p a=it's>x's<p>y", "it\nx's\ny"), ("<object>kept</object>", "kept"), ("a < b and <3", "a < b and <3")):
        got = html_extract.extract(page)
        assert want is None or got == want, page[:40]
    assert time.process_time() - began < 30


def test_html_bare_text():
    line, quote = "Bare text of the article, as old pages have it, in one line. " * 3, "A paragraph of the quotation that has its hundred characters of words and goes on to the end of line."
    page = "<body>" + "<br>".join(f"{line}<b>{i}</b>" for i in range(10)) + "<blockquote>" + f"<p>{quote}</p>" * 5 + "</blockquote>" + "<br>".join(f"{line}{i}" for i in range(10, 20)) + "</body>"
    got = html_extract.extract(page)
    assert got.count("Bare text") == 60 and got.count("A paragraph") == 5 and got.index("Bare") < got.index("A paragraph") and got.rstrip().endswith("19")
    links = " | ".join(f"<a href=/{i}>Menu {i}</a>" for i in range(30))
    assert "Menu" not in html_extract.extract(f"<body>{links}<blockquote>" + f"<p>{quote}</p>" * 5 + "</blockquote></body>")


def test_html_declared_parts_with_the_article():
    para = "A paragraph of the article with some words, a few commas, and an end."
    body = f"<p>{para}</p>" * 6
    side = "<div class=sidebar>" + "<a href=x>Link</a> " * 9 + "side words</div>"
    for page in (f"<form id=aspnetForm><div>{body}</div></form>", f"<div class='content no-sidebar'>{body}</div>{side}", f"<h1>T</h1><div class='content no-sidebar'>{body}</div>",
                 f"<aside>{body}</aside>", f"<form>{body}</form><form>{body}</form>"):
        got = html_extract.extract(f"<html><body>{page}</body></html>")
        assert got.count(para) == page.count(para) and "side words" not in got, page
    for part in (f"<section class='related-work'><h2>Before us</h2>{body}</section>", f"<section id='discussion'><h2>What it means</h2>{body}</section>"):
        assert html_extract.extract(f"<article><h1>T</h1>{body * 2}{part}</article>").count(para) == 18, part
    for part in (f"<div id=comments>{body * 3}</div>", f"<div class=discussion><div class=comment>{body}</div></div>", "<div class=related>" + "<a href=x>Other article</a> " * 9 + "</div>", "<nav>x</nav>", f"<footer>{body * 3}</footer>", f"<aside>{body * 3}</aside>"):
        assert html_extract.extract(f"<article><h1>T</h1>{body}</article>{part}") == "T\n" + "\n".join([para] * 6), part


def test_deobfuscation():
    counts = sum(toxicity.trigram_counts(t) for t in ["you are an idiot and a moron scum", "the stupid loser is pathetic trash"] * 50)
    lm = toxicity.language_model(counts)
    for noisy, plain in (("id1ot", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("p@thetic", "pathetic"), ("s.t.u.p.i.d", "stupid"), ("tr4sh!!", "trash"), ("plain,", "plain"), ("123", ""), ("$$$", "")):
        assert toxicity.restore(noisy, lm) == plain
    assert b"idiot" in toxicity.tokens_of("You I d i o t now")[1]


ENGLISH = ["you are such a loser and an idiot and a moron scum", "the stupid loser is pathetic trash and what an imbécile he is in the end"] * 50


def test_deobfuscation_of_spacing():
    lm = toxicity.language_model(sum(toxicity.trigram_counts(t) for t in ENGLISH))
    reader = toxicity.Reader(lm, None)
    for noisy, plain in (("such a l o s e r", "loser"), ("what s c u m, he", "scum"), ("i  d  i  o  t", "idiot"), ("so st up id", "stupid"), ("stu pid", "stupid"), ("s . c . u . m", "scum"), ("an i m b é c i l e", "imbécile"), ("m 0 r o n", "moron")):
        assert plain.encode() in toxicity.tokens_of(noisy, reader._join)[1], noisy
        assert set(toxicity.features_of(plain)) <= set(reader.read(noisy)[0])
    assert toxicity.tokens_of("1 2 3 4", reader._join) == ([b"1", b"2", b"3", b"4"], [])
    assert reader._join(" ".join("stupid" * 20_000)) and max(map(len, reader.runs)) <= toxicity.CACHE_RUN


def test_deobfuscation_of_edges():
    more = ["what a clown and an ass he is in the dumb shit of a bitch"] * 50
    lm = toxicity.language_model(sum(toxicity.trigram_counts(t) for t in ENGLISH + more))
    reader = toxicity.Reader(lm, None)
    for noisy, plain in (("!d!ot", "idiot"), ("(lown", "clown"), ("a$$", "ass"), ("idi0+", "idiot"), ("@$$", "ass"), ("$#!+", "shit"), ("8!7(#", "bitch"), ('"!d!ot!!"', "idiot"), ("idiot###", "idiot"), ("(idiot)", "idiot"), ("clown!", "clown")):
        assert plain in toxicity.meanings(noisy, lm), noisy
        assert set(toxicity.features_of(plain)) <= set(reader.read(noisy)[0])
    for none in ("$500", "(2019)", "+44", "1+1", "!!", "|", "$$$", "4/5!", "=", "50%"):
        assert toxicity.restore(none, lm) == "" and not reader.read(none)[0], none


def test_deobfuscation_of_doubled_letters():
    lm = toxicity.language_model(sum(toxicity.trigram_counts(t) for t in [*ENGLISH, *["all good books"] * 50]))
    for noisy, plain in (("stuupid", "stupid"), ("iidioot", "idiot"), ("loosser", "loser"), ("sstupidd!", "stupid"), ("iddi0tt", "idiot"), ("moronn", "moron")):
        assert plain in toxicity.meanings(noisy, lm), noisy
        assert set(toxicity.features_of(plain)) <= set(toxicity.Reader(lm, None).read(noisy)[0])
    assert all(w in toxicity.meanings(w, lm) for w in ("all", "good", "asshole", "pussy", "unseenn"))


def brute_decode(lattice, lm):
    """The least cost over every path of a lattice."""
    best = None
    for path in itertools.product(*lattice):
        a = b = 0
        cost = sum(extra for _, extra in path)
        for ch in "".join(s for s, _ in path):
            z = toxicity.INDEX.get(ch, toxicity.OTHER)
            cost, a, b = cost + lm[a * toxicity.K**2 + b * toxicity.K + z], b, z
        cost += lm[a * toxicity.K**2 + b * toxicity.K]
        best = cost if best is None else min(best, cost)
    return best


def test_viterbi_against_all_paths():
    lm = toxicity.language_model(sum(toxicity.trigram_counts(t) for t in ENGLISH)).tolist()
    rng = random.Random(3)
    for _ in range(300):
        lattice = toxicity.readings("".join(rng.choice("aabiot01!|$@s.") for _ in range(rng.randrange(1, 8))))
        if rng.random() < 0.5:
            lattice = lattice + [[("", toxicity.COST_JOIN), (" ", 0.0)]] + toxicity.readings(rng.choice(["it", "d0", "!"]))
        path = toxicity.viterbi(lattice, lm)
        assert len(path) == len(lattice)
        chosen = [[o for o in options if o[0] == s][:1] for s, options in zip(path, lattice)]
        assert abs(brute_decode(chosen, lm) - brute_decode(lattice, lm)) < 1e-9


def test_tokens_set_aside_have_no_chosen_feature():
    lm = toxicity.language_model(sum(toxicity.trigram_counts(t) for t in ENGLISH))
    chosen = [f for w in ("idiot", "moron", "ass", "stupid", "aa", "aaaa", "scum") for f in toxicity.features_of(w)]
    fast, slow = toxicity.Reader(lm, chosen), toxicity.Reader(lm, None)
    rng = random.Random(8)
    bits = ["id", "i", "d", "iot", "mor", "0n", "as", "s", "a", "aa", "!", "1", "sc", "um", "u", "st", "pid", " ", " ", ",", "x", "zz", "o"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
        want = Counter(f for f in slow.read(text)[0] if f in fast.slot)
        assert Counter(chosen[i] for i in fast.read(text)[0]) == want, text


def test_toxicity(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = words(rng, 40).split()
        if bad:
            for _ in range(2):
                w[rng.randrange(40)] = rng.choice(["idiot", "1d1ot", "moron", "m0ron"])
        docs.append((i, " ".join(w), "s"))
        labels.append((i, int(bad)))
    docs += [(1000, None, "s"), (1001, "", None)]
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table(spark, docs), lab).collect()}
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    test = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert sum(p == y for p, y in test) >= 0.95 * len(test) and not got[1000]["predicted"]
    clean = toxicity.keep_clean(table(spark, docs), lab)
    assert clean.columns == table(spark, docs).columns and {r["doc_id"] for r in clean.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert all(abs(r["score"] - 1 / (1 + np.exp(5.0))) < 1e-9 for r in toxicity.toxicity(table(spark, docs), lab.limit(0)).collect())


def held_by_workers(spark, names):
    """The most objects of each class that any Python worker still holds between jobs."""

    def run(batches):
        import gc

        import pyarrow as pa

        for batch in batches:
            gc.collect()
            kinds = [type(o).__name__ for o in gc.get_objects()]
            yield pa.RecordBatch.from_arrays([pa.array([kinds.count(n)] * len(batch), pa.int64()) for n in names], list(names))

    return spark.range(0, 64, 1, 64).mapInArrow(run, ", ".join(f"{n} long" for n in names)).agg(*[F.max(n) for n in names]).first()


def test_workers_hold_one_operators_state(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 30) + (" you stupid idiot" if i % 2 else ""), "a") for i in range(128)]
    docs, labels = table(spark, rows).repartition(32), spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id long, toxic int")
    bench, names = spark.createDataFrame([(1, rows[4][1])], "item_id long, text string"), ("Reader", "Vocabulary")
    toxicity.toxicity(docs, labels).collect()
    assert tuple(held_by_workers(spark, names)) == (1, 0)  # kept for the next tasks
    minhash.near_duplicates(docs).collect()
    assert tuple(held_by_workers(spark, names)) == (0, 0)
    toxicity.toxicity(docs, labels).collect()
    decontaminate.contaminated(docs, bench).collect()
    assert tuple(held_by_workers(spark, names)) == (0, 1)
    mixing.mix(docs).collect()
    toxicity.toxicity(docs, labels).collect()
    assert tuple(held_by_workers(spark, names)) == (1, 0)


def test_pipeline_hard_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int, _k int, id int, size int"
    hard = [(None, None, None, None, None, 1, 2, 3, 4), (None, "only words here", None, None, None, 1, 2, 3, 4), (1, None, "en", None, 0, 1, 2, 3, 4), (2, "", "en", "a", 0, 1, 2, 3, 4)]
    hard += [(3, "same words in two rows", "en", "a", 1, 1, 2, 3, 4)] * 2 + [(9, "w " * 40_000, None, "a", 1, 1, 2, 3, 4)]
    for name, docs in (("hard", hard), ("empty", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(None, None, 1), (1, 0, None)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(None, "only words here"), (4, None)] if docs else [], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        got = corpus_pipeline.run(spark, sf).collect()
        assert {r["doc_id"] for r in got} <= {d[0] for d in docs} and len({(r["shard"], r["slot"]) for r in got}) == len(got)


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    sf = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    leak = rows[10][1] if len(rows[10][1].split()) > 20 else rows[11][1]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    comp = brute_components(rows, 80)
    keep = {i for i, (_, c) in comp.items() if i == c}
    ids = {r["doc_id"] for r in got}
    assert ids <= keep and not {i for i, t, _ in rows if t == leak} & ids
    assert max(Counter(r["doc_id"] for i, r in enumerate(got)).values()) <= 6 and len({(r["shard"], r["slot"]) for r in got}) == len(got)
