"""Benchmark decontamination by template canonicalisation.

Words lose their case and edge punctuation; numbers, units and names become typed placeholders whose values are
kept as slots. Windows of template words of the benchmark and of the documents meet in a hash join (the
benchmark's side is a block of bounded size that every task holds, so documents never move; a larger
benchmark takes one pass per block). A hit counts when its words agree and half of them are no slots. The slots of a
copy must be consistent: one value of the item always becomes the same value of the document, and two values never become
one. A copy whose slots clash is judged again by each of its diagonals (an inserted word may part two copies), and one that
clashes there too has only the windows that keep the item's values. Two canonical forms are joined, with and without names as
slots, so that changes of case and changes of names are both caught. Windows of more slots, and items of fewer than
four words, meet by their values instead, so that copies which keep the values are found whatever they hold. A
document holds an item when such windows cover half of the item's words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import place_of, text_in, text_slices, worker_state
from trailspark.llm.shingles import windows

WINDOW, COVERAGE = 8, 0.5
#: Benchmark text that a task holds at once, and tokens that a worker remembers.
BLOCK_BYTES, CACHE_TOKENS = 32 << 20, 400_000

#: Number words and units in the languages of the corpus; digits, signs and the shape of names need no list.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred "
    "thousand million billion half third quarter dozen "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille demi douzaine "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend dutzend "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil medio docena".split())
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons ms s sec second seconds "
    "minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters dollar dollars cent cents euro euros percent "
    "degree degrees mph kmh watt watts volt volts joule joules newton newtons hz khz mhz ghz "
    "heure heures jour jours semaine semaines mois an ans année années mètre mètres kilomètre kilomètres gramme grammes degré degrés "
    "sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate jahr jahre jahren kilometern gramm grad "
    "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años metro metros kilómetro kilómetros gramo gramos grado grados".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_MEASURE = re.compile(r"[+-]?\d[\d.,]*([a-zA-Z]+)")
#: Signs that are no part of a word at either of its ends.
_EDGE_SIGNS = "!\"#&'()*,./:;<=>?@[\\]^`{|}~"
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
NUM, UNIT, NAME, MEASURE = "\0num", "\0unit", "\0name", "\0measure"
#: The form of a word that is its value.
VALUE = 2


def canonical(token: str) -> tuple[str, str, str] | None:
    """(word with numbers and units typed, the same with names typed, value); None for bare punctuation."""
    word = token.strip(_EDGE_SIGNS)
    if word.isalpha():
        low = word.lower()
        if low in NUMBER_WORDS:
            return NUM, NUM, low
        if low in UNITS:
            return UNIT, UNIT, low
        return low, NAME if word[0].isupper() and not word[1:].isupper() else low, low
    word = _EDGE.sub("", word)
    if not any(c.isalnum() for c in word):
        return None
    low = word.lower()
    m = _MEASURE.fullmatch(word)
    if m and m[1].lower() in UNITS:
        return MEASURE, MEASURE, low
    if _NUMBER.fullmatch(word) or low in NUMBER_WORDS:
        return NUM, NUM, low
    if low in UNITS:
        return UNIT, UNIT, low
    return low, NAME if word[0].isupper() and not word[1:].isupper() else low, low


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class Vocabulary:
    """Remembers the hashes of the canonical forms of tokens."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros((1 << 10, 3), np.uint64)
        self.typed = {x: _hash(x) for x in (NUM, UNIT, NAME, MEASURE)}

    def _learn(self, token: bytes) -> None:
        n = len(self.known) + 1
        if n == len(self.hashes):
            self.hashes = np.vstack([self.hashes, np.zeros_like(self.hashes)])
        c = canonical(token.decode("utf-8", "replace"))
        if c is not None:
            low = _hash(c[VALUE])
            self.hashes[n] = [low if x is c[VALUE] else self.typed[x] for x in c]
        self.known[token] = n

    def read(self, text: str | None) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that hold a word, and the hashes of their three forms."""
        tokens, known = (text or "").encode("utf-8", "surrogatepass").split(), self.known
        if len(known) > CACHE_TOKENS:
            known.clear()
            self.hashes[:] = 0
        for t in set(tokens).difference(known):
            self._learn(t)
        rows = self.hashes[np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))]
        keep = rows[:, 0] != 0
        if not keep.all():
            tokens, rows = [t for t, k in zip(tokens, keep.tolist()) if k], rows[keep]
        return tokens, *np.ascontiguousarray(rows.T)


def _slots(words: list[tuple[str, str, str]], form: int) -> list[bool]:
    return [w[form].startswith("\0") for w in words]


class Index:
    """The template windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        vocab, at, self.window = Vocabulary(), defaultdict(list), window
        self.words: dict[int, list[tuple[str, str, str]]] = {}
        for item, text in items:
            tokens, *forms = vocab.read(text)
            words = [canonical(t.decode("utf-8", "replace")) for t in tokens]
            self.words[item] = words
            n = min(window, len(words))
            few = [[n >= 4 and 2 * sum(_slots(words[i : i + n], form)) <= n for i in range(len(words) - n + 1)] for form in (0, 1)]
            few.append([not x for x in few[0]])
            for form, hashes in enumerate(forms if words else ()):
                for i, h in enumerate(windows(hashes, n).tolist()):
                    if few[form][i]:
                        at[h].append((item, i, n, form))
        self.at, self.kinds = dict(at), sorted({(n, form) for v in at.values() for _, _, n, form in v})
        hashes = np.array(sorted(at), np.uint64)
        self.bits = max(16, int(len(hashes)).bit_length() + 6)
        self.mask = np.zeros(1 << self.bits, bool)
        self.mask[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, forms) -> list[tuple[int, int, int, int, int]]:
        """(document position, item, item position, length, form) of equal windows."""
        out = []
        for n, form in self.kinds:
            w = windows(forms[form], n)
            for p in np.flatnonzero(self.mask[(w >> np.uint64(64 - self.bits)).astype(np.int64)]).tolist():
                out += [(p, item, i, n, form) for item, i, m, f in self.at.get(int(w[p]), ()) if m == n and f == form]
        return out


def copies(found: list[tuple], width: int) -> list[list[tuple]]:
    """Hits, the diagonal first in each, by copy of the item: all that lie within ``width`` diagonals of any one on. A
    copy is thus whole wherever it starts; such stretches overlap where many copies stand close."""
    found, out, end = sorted(found, key=lambda h: h[0]), [], 0
    for k, hit in enumerate(found):
        if k and hit[0] == found[k - 1][0]:
            continue
        stop = max(end, k)
        while stop < len(found) and found[stop][0] < hit[0] + width:
            stop += 1
        if stop > end:
            out.append(found[k:stop])
            end = stop
    return out


def consistent(pairs) -> bool:
    """Whether every value of the item has one value in the document, and no two have the same one."""
    there, back = {}, {}
    return all(there.setdefault((kind, old), new) == new and back.setdefault((kind, new), old) == old for kind, old, new in pairs)


def assess(group: list[tuple], size: int) -> tuple[int, float, bool]:
    """(windows that count, share of the item's words they cover, verbatim) of one copy."""
    if not consistent(pair for *_, pairs in group for pair in pairs):
        if len({h[0] for h in group}) > 1:
            alone = [list(g) for _, g in groupby(sorted(group, key=lambda h: h[0]), key=lambda h: h[0])]
            return max((assess(g, size) for g in alone), key=lambda b: (b[1], b[0]))
        group = [h for h in group if all(old == new for _, old, new in h[-1])]
    covered, verbatim = np.zeros(size, bool), True
    for _, i, n, _, pairs in group:
        covered[i : i + n] = True
        verbatim &= all(old == new for _, old, new in pairs)
    return len(group), float(covered.mean()), verbatim


def judge(tokens: list[bytes], index: Index, hits) -> list[tuple[int, int, float, bool]]:
    """(item, windows that count, share of the item's words they cover, verbatim) by item."""
    by_item, out = defaultdict(list), []
    for p, item, i, n, form in hits:
        by_item[item].append((p, i, n, form))
    for item, found in sorted(by_item.items()):
        words, lined = index.words[item], []
        for p, i, n, form in found:
            here = [canonical(t.decode("utf-8", "replace")) for t in tokens[p : p + n]]
            there = words[i : i + n]
            if any(a[form] != b[form] for a, b in zip(here, there)):
                continue
            lined.append((p - i, i, n, form, [(b[form % VALUE], b[2], a[2]) for a, b in zip(here, there) if b[form % VALUE].startswith("\0")]))
        # Windows that lie near one diagonal belong to one copy of the item; each copy is judged alone.
        best = max((assess(group, len(words)) for group in copies(lined, max(8, len(words)))), key=lambda b: (b[1], b[0]), default=(0, 0.0, False))
        if best[0]:
            out.append((item, *best))
    return out


def _blocks(docs: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text: str, block_bytes: int):
    """For each block of the benchmark, of ``block_bytes`` of text, what turns texts to lists of what ``judge`` finds."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        rows = sorted((r["item"], r["t"] or "") for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect())
        shared = docs.sparkSession.sparkContext.broadcast((rows, window))
        stamp = f"{b}:{window}:{hash(tuple(rows))}"

        def find(texts, coverage, shared=shared, stamp=stamp):
            index, vocab = worker_state(("decontaminate", stamp), lambda: (Index(*shared.value), Vocabulary()))
            for text in texts:
                tokens, *forms = vocab.read(text)
                hits = index.hits(forms)
                yield [j for j in judge(tokens, index, hits) if j[2] >= coverage] if hits else ()

        yield find


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item it holds: id, item_id, n_windows, coverage, verbatim.

    Null or empty texts hold nothing, and items without a word are held by nothing; items shorter than a window
    are one window, and those of fewer than four words are found by their values only. Repeated rows give repeated
    results; of items that share an id the last read in order of their texts counts. Null item ids are left out, null
    document ids are kept. Without items, or on an empty table, there are no rows. Other columns are ignored, whatever
    their names.
    """
    src, out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    id_type = src.schema["id"].dataType.simpleString()
    for find in _blocks(docs, benchmark, window, item_col, item_text, block_bytes):

        def run(batches, find=find):
            for big in batches:
                for batch in text_slices(big):
                    found = [(k, *j) for k, js in enumerate(find(batch.column("text").to_pylist(), coverage)) for j in js]
                    at, *cols = list(zip(*found)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                                      pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], ["id", "item_id", "n_windows", "coverage", "verbatim"])

        part = src.mapInArrow(run, f"id {id_type}, item_id long, n_windows long, coverage double, verbatim boolean")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, each row by its own text: ids do not matter, and no row moves."""
    rows, text = docs.select(F.struct(*docs.columns).alias("_row")), ("_row", place_of(docs, text_col))
    schema = rows.schema
    for find in _blocks(docs, benchmark, window, item_col, item_text, block_bytes):

        def run(batches, find=find):
            for big in batches:
                for batch in text_slices(big, text):
                    yield batch.filter(pa.array([not js for js in find(text_in(batch, text).to_pylist(), coverage)], pa.bool_()))

        rows = rows.mapInArrow(run, schema)
    return rows.select("_row.*")
