"""Toxicity scores of restored text.

A character language model (trigrams counted over every document) judges how noisy spellings were meant: each
token becomes a lattice of readings (letters as they are, leetspeak as the letters it stands for, separators
as nothing, repeated letters as one or two) and Viterbi decoding picks the likeliest path. Runs of short tokens
share one lattice in which each space may be nothing or a word edge; the words that such a path joins
count besides the tokens. Restored words are then scored by a logistic regression over word and
word-beginning features, fitted on a bounded sample of labelled rows.

A token that has one reading only is its own decoding, so the lattice is built just for the others; each distinct
token is decoded once per worker.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspark.llm.common import drop_worker_state, place_of, text_in, text_slices, worker_state

#: The model's alphabet: word edge, a-z, the letters of Latin-1 and one class for all other letters.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
K = len(LETTERS) + 2
EDGE, OTHER = 0, K - 1
INDEX = {c: i + 1 for i, c in enumerate(LETTERS)} | {" ": EDGE}
_TABLE = np.zeros(0x250, np.int64)
_TABLE[[ord(c) for c in LETTERS]] = np.arange(1, K - 1)
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "#": "h", "€": "e", "£": "l", "µ": "u"}
#: Costs of the channel, in nats: a sign read as a letter, a sign dropped, a digit dropped, a repeated letter dropped, a space dropped.
COST_LEET, COST_DROP, COST_DIGIT, COST_REPEAT, COST_JOIN = 1.0, 1.5, 20.0, 0.5, 3.0
#: Labelled rows and features of the fit, and tokens and runs (of so many characters at most) a worker remembers.
MAX_LABELLED, FEATURES, CACHE_TOKENS, CACHE_RUN = 8_000, 400, 400_000, 64
#: Letters, once repeated ones are one, by which tokens that cannot hold a chosen feature are set aside.
HEAD = 4

#: Signs that stand for no letter.
_PLAIN = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LEET)
_TRIPLED = re.compile(r"[^a-zß-öø-ÿ]|(.)\1\1")
#: Letters that the next one does not repeat.
_STRETCH = re.compile(r"(?:([a-zß-öø-ÿ])(?!\1))+")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_LEADING = re.compile(r"[^\W\d_]*")
_REPEATED = re.compile(r"(.)\1+", re.S)
#: Numbers as they are written, with signs around them.
_NUMBER = re.compile(r"[^\w\s]*[$€£]?\d+(?:[.,:/+x|-]\d+)*[^\w\s]*")
_ODD = re.compile(r"[^a-zß-öø-ÿ]|(.)\1")
#: Runs of tokens of one to three letters or digits, with signs around them or alone.
_PART = r"(?:[^\w\s]{0,3}\w{1,3}[^\w\s]{0,3}|[^\w\s]{1,3})(?!\S)"
_APART = re.compile(rf"(?<!\S){_PART}(?:\s+{_PART})+")


def trigram_counts(text: str) -> np.ndarray:
    """Counts of character trigrams within the words of a text; signs and digits count as edges."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    x = np.where(code < 0x250, _TABLE[np.minimum(code, 0x24F)], OTHER)
    x = np.concatenate([[0, 0], x, [0, 0]])
    return np.bincount(x[:-2] * K * K + x[1:-1] * K + x[2:], minlength=K**3)


def corpus_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all documents: partial sums per task, one row per trigram to the driver (K**3 at most)."""

    def run(batches):
        drop_worker_state()
        total = np.zeros(K**3, np.int64)
        for big in batches:
            for batch in text_slices(big):
                total += trigram_counts("\n".join(t or "" for t in batch.column("text").to_pylist()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["g", "n"])

    out = np.zeros(K**3, np.int64)
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        out[r["g"]] = r["n"]
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b) by a * K * K + b * K + c, smoothed by bigrams and letters."""
    c3 = counts.reshape(K, K, K).astype(float)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1 + 1).sum()
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
    return -np.log(p3).reshape(-1)


def readings(token: str, fold: bool = True) -> list[list[tuple[str, float]]]:
    """The lattice: for each position the strings it may stand for, with their costs; doubled letters are one
    letter or two, or with ``fold`` off as spelled."""
    out, i = [], 0
    while i < len(token):
        if m := _STRETCH.match(token, i):
            c, j = token[i], m.end()
        else:
            c, j = token[i], i
        while not m and j < len(token) and token[j] == c:
            j += 1
        if c.isalpha():
            if m or j - i < 2 or j - i == 2 and not fold:
                # Letters with one reading are one position.
                if i and len(out[-1]) == 1 and out[-1][0][1] == 0.0:
                    out[-1] = [(out[-1][0][0] + token[i:j], 0.0)]
                else:
                    out.append([(token[i:j], 0.0)])
            else:
                out.append([(c, COST_REPEAT), (c + c, COST_REPEAT if j - i > 2 else 0.0)])
        elif c in LEET:
            opts = [(x, COST_LEET) for x in LEET[c]] + [(x + x, COST_LEET + COST_REPEAT) for x in LEET[c] if j - i > 1]
            out.append(opts + [("", COST_DIGIT if c.isdigit() else COST_DROP)])
        else:
            out.append([("", COST_DROP)])
        i = j
    return out


def viterbi(lattice: list[list[tuple[str, float]]], lm: np.ndarray) -> list[str]:
    """The cheapest path under channel and language model: one string for each position."""
    states = {EDGE: (0.0, None)}  # by the last two letters, a * K + b
    for options in lattice:
        nxt: dict[int, tuple[float, tuple]] = {}
        for s, extra in options:
            letters = [INDEX.get(ch, OTHER) for ch in s]
            for at, (cost, path) in states.items():
                total = cost + extra
                for z in letters:
                    total += lm[at * K + z]
                    at = at % K * K + z
                old = nxt.get(at)
                if old is None or total < old[0]:
                    nxt[at] = (total, (path, s))
        states = nxt
    path, out = min((cost + lm[at * K + EDGE], i, path) for i, (at, (cost, path)) in enumerate(states.items()))[2], []
    while path is not None:
        path, s = path
        out.append(s)
    return out[::-1]


def trim(token: str, keep=()) -> str:
    """Without the signs at its edges, but those of ``keep``."""
    token = token.strip(_PLAIN)
    i, j = 0, len(token)
    while i < j and not token[i].isalnum() and token[i] not in keep:
        i += 1
    while i < j and not token[j - 1].isalnum() and token[j - 1] not in keep:
        j -= 1
    return token[i:j]


def core_of(token: str) -> tuple[str, str, str]:
    """A token without edges that stand for no letter: signs before its first letter or digit, the rest, signs behind.
    Without any letter, only two signs at least that stand for different ones (or one beside a digit) may mean a
    word, and numbers with signs around them do not; all else is empty."""
    core = trim(token, LEET)
    if any(c.isalpha() for c in core):
        middle = trim(core)
        at = core.index(middle)
        return core[:at], middle, core[at + len(middle) :]
    signs = {c for c in core if c in LEET}
    return "", "" if len(signs) < 2 or all(c.isdigit() for c in signs) or _NUMBER.fullmatch(core) else core, ""


def firm(lattice: list[list[tuple[str, float]]]) -> list[list[tuple[str, float]]]:
    """The lattice without dropping what may be read."""
    return [[o for o in options if o[0]] or options for options in lattice]


def decode(before: str, middle: str, behind: str, lm: np.ndarray, read: bool = False, fold: bool = True) -> str:
    """The likeliest word of the parts of a token; with ``read``, the signs at its edges are letters, and with
    ``fold`` doubled letters may be one."""
    if not middle or not (before or behind or (_ODD if fold else _TRIPLED).search(middle)):
        return middle
    edges, inner = [readings(before) if before else [], readings(behind) if behind else []], readings(middle, fold)
    if read:
        edges = [firm(e) for e in edges]
    if not any(c.isalpha() for c in middle):
        inner = firm(inner)
    return "".join(viterbi(edges[0] + inner + edges[1], lm))


def restore(token: str, lm: np.ndarray) -> str:
    """One lower-cased token as it was meant; tokens that stand for no word give none."""
    if token.isalpha():
        return decode("", token, "", lm)
    return decode(*core_of(token), lm)


def meanings(token: str, lm: np.ndarray) -> list[str]:
    """The word that a token was meant as, and those with its doubled letters as spelled and the signs at either
    edge all dropped or all read: doubled letters are often meant, and marks of punctuation look like letters."""
    core = trim(token, LEET)
    words = [restore(core, lm)]
    if not core.isalpha() or _ODD.search(core):
        before, middle, behind = ("", core, "") if core.isalpha() else core_of(core)
        for a in {before, ""}:
            for b in {behind, ""}:
                if before or behind:
                    words.append(decode(a, middle, b, lm, read=True))
                if _DOUBLED.search(middle):
                    words.append(decode(a, middle, b, lm, read=True, fold=False))
    return [w for w in sorted(set(words)) if w]


def stretches(run: str) -> list[str]:
    """Three or more single characters in a row, joined, whatever signs stand around or between them."""
    out = [""]
    for t in run.split():
        one = "".join(c for c in t if c.isalnum() or c in LEET)
        out[-1:] = [out[-1] + one] if len(one) < 2 else [out[-1], ""]
    return [w for w in out if len(w) > 2]


def join_apart(run: str, lm: np.ndarray) -> list[str]:
    """The words that a lower-cased run of short tokens spells apart, and its stretches of three or more single
    characters as a whole; tokens that are words of their own are none."""
    parts = [t for t in run.split() if any(c.isalnum() or c in LEET for c in t)]
    if len(parts) < 2 or not any(c.isalpha() for c in run):
        return []
    lattice, ends = [], []
    for t in parts:
        lattice += [*readings(trim(t, LEET)), [("", COST_JOIN), (" ", 0.0)]]
        ends.append(len(lattice) - 1)
    pieces, words, start, n = viterbi(lattice[:-1], lm), [], 0, 0
    for end in ends:
        n += 1
        if end == len(pieces) or pieces[end]:
            if n > 1:
                words.append("".join(pieces[start:end]))
            start, n = end + 1, 0
    return list(dict.fromkeys([w for w in words if w] + stretches(run)))


def tokens_of(text: str | None, join=stretches) -> tuple[list[bytes], list[bytes]]:
    """Lower-cased tokens, and the words that ``join`` makes of runs of short tokens."""
    low = (text or "").lower()
    return low.encode("utf-8", "surrogatepass").split(), [w.encode("utf-8", "surrogatepass") for m in _APART.findall(low) for w in join(m)]


def features_of(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 8 letters."""
    return [f"={word}", *(f"^{word[:n]}" for n in range(4, min(len(word), 8) + 1))] if word else []


def collapse(letters: str) -> str:
    """Repeated letters as one. Every reading of letters collapses to the same, and letters are never dropped."""
    return _REPEATED.sub(r"\1", letters)


class Reader(dict):
    """Texts to their (chosen) features; maps each token to its features and remembers them.

    A token whose readings all begin with letters that no chosen feature begins with has none, and is not decoded; so it is
    with the words that a run of short tokens may spell.
    """

    def __init__(self, lm: np.ndarray, chosen: list[str] | None):
        self.lm, self.runs, self.slot = lm.tolist(), {}, None
        if chosen is not None:
            self.slot = {f: i for i, f in enumerate(chosen)}
            heads = {f: collapse(f[1:])[:HEAD] for f in chosen}
            self.heads, self.brief = set(heads.values()), tuple({h for h in heads.values() if len(h) < HEAD})
            self.begun = tuple({h for f, h in heads.items() if f[0] == "^" and len(h) < HEAD})

    def may_match(self, letters: str, whole: bool) -> bool:
        """False only where no reading of ``letters`` (or with ``whole`` off, that begins with them) has a chosen feature."""
        head = letters[:HEAD]
        if len(head) < HEAD or head[0] == head[1] or head[1] == head[2] or head[2] == head[3]:
            head = collapse(letters)[:HEAD]
        if head in self.heads:
            return True
        return head.startswith(self.begun) if whole else len(head) < HEAD or head.startswith(self.brief)

    def __missing__(self, raw: bytes) -> tuple:
        token, found = raw.decode("utf-8", "replace").strip(_PLAIN), ()
        whole = token.isalpha()
        if self.slot is None or self.may_match(token if whole else _LEADING.match(token)[0], whole):
            found = tuple(dict.fromkeys(f for w in meanings(token, self.lm) for f in features_of(w)))
            if self.slot is not None:
                found = tuple(self.slot[f] for f in found if f in self.slot)
        self[raw] = found
        return found

    def _join(self, run: str) -> list[str]:
        words = self.runs.get(run)
        if words is None:
            parts = [] if self.slot is None else [p for t in run.split() if (p := t.strip(_PLAIN))]
            never = bool(parts) and "".join(parts).isalpha() and not any(self.may_match("".join(parts[i : i + 2 * HEAD]), False) for i in range(len(parts) - 1))
            words = [] if never else join_apart(run, self.lm)
            if len(self.runs) > CACHE_TOKENS:
                self.runs.clear()
            if len(run) <= CACHE_RUN:
                self.runs[run] = words
        return words

    def read(self, text: str | None) -> tuple[list, int]:
        """The features of a text, as often as they occur, and its number of tokens."""
        tokens, joined = tokens_of(text, self._join)
        if len(self) > CACHE_TOKENS:
            self.clear()
        return list(chain.from_iterable(filter(None, map(self.__getitem__, chain(tokens, joined))))), len(tokens)


def values(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Feature values: presence and rate, on a log scale."""
    return np.log1p(300.0 * counts / np.maximum(n, 1)[:, None])


def fit(x: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def choose(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, count: int = FEATURES) -> list[int]:
    """The features whose shares of toxic and clean rows differ most, by their z scores."""
    both = (pos + neg + 1) / (n_pos + n_neg + 2)
    z = (pos / max(n_pos, 1) - neg / max(n_neg, 1)) / np.sqrt(both * (1 - both) * (1 / max(n_pos, 1) + 1 / max(n_neg, 1)))
    z[pos < 3] = 0
    best = np.argsort(-z, kind="stable")[:count]
    return [int(i) for i in best if z[i] > 2]


def held_out(id_col: str = "doc_id"):
    """The rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, lm: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED):
    """(features, weights) from at most ``max_labelled`` labelled rows, those with the smallest hashed ids."""
    spark = docs.sparkSession
    rows = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sample = rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(max_labelled).collect()
    if len({r["y"] for r in sample}) < 2:
        return [], np.array([-5.0])
    small = F.broadcast(spark.createDataFrame([(r["id"], r["y"]) for r in sample], f"id {dict(labels.dtypes)[id_col]}, y int"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small, "id").select("text", "y")

    def presence(batches):
        reader, seen, n = Reader(lm, None), (Counter(), Counter()), [0, 0]
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                seen[y].update(set(reader.read(t)[0]))
                n[y] += 1
        names = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(["", *names], pa.string()), pa.array([n[1], *(seen[1][x] for x in names)], pa.int64()), pa.array([n[0], *(seen[0][x] for x in names)], pa.int64())], ["f", "pos", "neg"])

    stats = texts.mapInArrow(presence, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("f = '' or pos >= 3").toPandas()
    n_pos, n_neg = stats.loc[stats.f == "", ["pos", "neg"]].iloc[0] if (stats.f == "").any() else (0, 0)
    stats = stats[stats.f != ""].sort_values("f")
    if not n_pos or not n_neg:
        return [], np.array([-5.0])
    picked = choose(stats.pos.to_numpy(float), stats.neg.to_numpy(float), int(n_pos), int(n_neg))
    chosen = [stats.f.iloc[i] for i in picked]

    def vectors(batches):
        reader = Reader(lm, chosen)
        for batch in batches:
            got = [reader.read(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([g[1] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.list_(pa.int32()))], ["y", "n", "f"])

    got = texts.mapInArrow(vectors, "y int, n long, f array<int>").collect()
    got.sort(key=lambda r: (r["y"], r["n"], r["f"]))
    counts = np.zeros((len(got), len(chosen)))
    for i, r in enumerate(got):
        np.add.at(counts[i], r["f"], 1)
    return chosen, fit(values(counts, np.array([r["n"] for r in got])), np.array([float(r["y"]) for r in got]))


def score_texts(texts: list, reader: Reader, width: int, weights: np.ndarray) -> np.ndarray:
    counts, n = np.zeros((len(texts), width)), np.zeros(len(texts))
    for i, t in enumerate(texts):
        f, n[i] = reader.read(t)
        if f:
            np.add.at(counts[i], f, 1)
    return 1 / (1 + np.exp(-np.clip(values(counts, n) @ weights[:-1] + weights[-1], -30, 30)))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, whole: bool) -> DataFrame:
    """``_id`` (the id, or with ``whole`` the row as a structure) and ``_score``, in one pass; rows stay where they are."""
    src = docs.select(F.struct(*docs.columns).alias("_id")) if whole else docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    text = ("_id", place_of(docs, text_col)) if whole else "_t"
    lm = language_model(corpus_counts(docs, text_col)).astype(np.float32)
    chosen, weights = train(docs, labels, lm, id_col, text_col, label_col)
    stamp = zlib.crc32(lm.tobytes() + weights.tobytes())
    shared = docs.sparkSession.sparkContext.broadcast(lm)
    kept = [c for c in src.columns if c != "_t"]

    def run(batches):
        reader = worker_state(("toxicity", stamp), lambda: Reader(shared.value, chosen))
        for big in batches:
            for batch in text_slices(big, text):
                s = score_texts(text_in(batch, text).to_pylist(), reader, len(chosen), weights)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s, pa.float64())], [*kept, "_score"])

    schema = T.StructType([*(src.schema[c] for c in kept), T.StructField("_score", T.DoubleType())])
    return src.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Null and empty texts have no features and get the base score. A null id is not held out, nor ever learnt
    from. Repeated rows get equal scores; an id labelled twice is toxic if any label says so. Without
    labels of both kinds every score is the same low one. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    out = _scored(docs, labels, id_col, text_col, label_col, whole=False)
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` with scores below ``threshold``, with all their columns."""
    return _scored(docs, labels, id_col, text_col, label_col, whole=True).where(F.col("_score") < threshold).select("_id.*")
