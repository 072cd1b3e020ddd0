"""Token ids in a binary file format: per-document zstandard frames under one shared dictionary.

A file set is a folder with two tables that Spark's commit protocol writes, so lost executors leave no
torn files, on any file system Spark reaches:

* ``dictionary``: one row, ``sha256`` and ``bytes`` of the dictionary and the ``width`` of an id;
* ``blocks``: rows (part, seq) in ascending order of document id; each holds the index of its documents
  (``doc_ids``, ``counts``, ``offsets``), the ``dict_sha256`` it was written with, and ``payload``, the frames
  one after another. ``first_id`` and ``last_id`` let a reader skip files and pages, and an offset reads a
  document's frame alone.

The dictionary is trained on the serialized ids of at most ``SAMPLE_DOCS`` documents of ``SAMPLE_BYTES`` at most,
those with the smallest hashes; every document is then encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.llm.common import delete_path, new_path, text_slices, worker_state

SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 400, 64 << 10, 64 << 10
#: Payload bytes after which a block is closed, and distinct words an encoder remembers.
BLOCK_BYTES, CACHE_WORDS = 4 << 20, 400_000
#: Bytes of text whose words are looked up together.
SLICE_BYTES = 4 << 20
LEVEL = 3


#: Letters of Latin-1, which are their own composed forms and keep one character in lower case, then signs without apostrophe.
_LETTERS_SIGNS = r"^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>[!-&(-/:-@\[-`{-~]*)$"
#: The cutting rule under which letters, and the signs after them, are tokenized apart from all else.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _parts(spec: dict | None, many: str) -> list[dict]:
    return [] if spec is None else spec[many] if spec["type"] == "Sequence" else [spec]


def reads_words(config: str) -> bool:
    """Whether a tokenizer (its JSON) drops white space and case and cuts by ``_CUTS``, so that the ids of a text are those of its words,
    and the ids of letters and of the signs after them follow each other. Anything unknown in it means no."""
    spec = json.loads(config)
    normal = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in _parts(spec.get("normalizer"), "normalizers")]
    pre = _parts(spec.get("pre_tokenizer"), "pretokenizers")
    added = [t["content"] for t in spec.get("added_tokens", ()) if not t.get("single_word")]
    return (
        set(normal) <= {("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)} and ("Lowercase", None, None) in normal
        and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"].get("Regex") == _CUTS and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
        and not pre[1]["add_prefix_space"] and not pre[1].get("use_regex", True) and spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix")
        and not any(re.search(r"\s", t) or re.fullmatch(_LETTERS_SIGNS, t) for t in added))


class Ragged:
    """Rows of ids by key, appended to; emptied by its owner."""

    def __init__(self, dtype: str):
        self.row, self.length, self.ids = {}, np.zeros(1, np.int64), np.zeros(0, dtype)
        self.start = np.zeros(1, np.int64)

    def add(self, keys: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.row)
        self.row.update(zip(keys, range(first, first + len(keys))))
        ends = np.cumsum(lengths) + len(self.ids)
        self.length = np.concatenate([self.length[:first], lengths, [0]])
        self.start = np.concatenate([self.start[:first], ends - lengths, [0]])
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each row, one row after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


class Encoder:
    """Whole texts to little-endian ids. Where white space separates words for the tokenizer, each distinct word of a
    slice is looked up once and each word is tokenized once and remembered; the memory is emptied at
    ``CACHE_WORDS``. Other tokenizers get whole texts."""

    def __init__(self, tokenizer_path: str, end_id: int, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.type = Tokenizer.from_file(tokenizer_path), f"<u{width}"
        with open(tokenizer_path, encoding="utf-8") as f:
            config = f.read()
        self.words, self.end_id = reads_words(config), end_id
        if self.words:
            vocab, suffix = self.tok.get_vocab(), json.loads(config)["model"]["end_of_word_suffix"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.known = Ragged(self.type)

    def _tokenize(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str], runs: bool) -> None:
        """Remember words; those of ``runs`` are one run of letters or signs each and end where an end-of-word id stands."""
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            if runs:
                ids = np.array(self._tokenize([" ".join(part)])[0], np.int64)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(part):
                    self.known.add(part, np.diff(ends, prepend=0), ids)
                    continue
            got = self._tokenize(part)
            self.known.add(part, np.array([len(x) for x in got], np.int64), np.array([i for x in got for i in x], np.int64))

    def _rows(self, words: pa.Array, runs: bool) -> np.ndarray:
        """Where the distinct words of an array are remembered."""
        words, row = words.to_pylist(), self.known.row
        new = [w for w in words if w not in row]
        if new:
            self._learn(new, runs)
        return np.fromiter(map(row.__getitem__, words), np.int64, len(words))

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if len(self.known.row) > CACHE_WORDS:
            self.known = Ragged(self.type)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        cut = pc.extract_regex(words, _LETTERS_SIGNS)
        whole = np.asarray(cut.is_null())
        n = len(words)
        first, second = np.full(n, -1), np.full(n, -1)
        first[whole] = self._rows(words.filter(pa.array(whole)), False)
        cut = cut.drop_null()
        for out, part in ((first, pc.utf8_lower(cut.field("a"))), (second, cut.field("b"))):
            d = part.dictionary_encode()
            rows = self._rows(d.dictionary, True) if "" not in (values := d.dictionary.to_pylist()) else self._with_empty(values)
            out[np.flatnonzero(~whole)] = rows[d.indices.to_numpy()]
        # A row before all others, of no ids, stands for what is not there.
        start, length = np.concatenate([[0], self.known.start[:-1]]), np.concatenate([[0], self.known.length[:-1]])
        both = np.stack([first[at], second[at]], 1).reshape(-1) + 1
        size = length[both]
        ids = self.known.ids[expand(start[both], size)]
        per_word = np.concatenate([[0], np.cumsum(size)])
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids, np.diff(per_word[2 * bounds])

    def _with_empty(self, values: list[str]) -> np.ndarray:
        rows = np.full(len(values), -1)
        some = [i for i, v in enumerate(values) if v]
        rows[some] = self._rows(pa.array([values[i] for i in some], pa.string()), True)
        return rows

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text with the end id, as bytes. A null text is empty."""
        texts = pc.fill_null(texts, "")
        if self.words:
            ids, counts = self._by_word(texts)
        else:
            got = self._tokenize(texts.to_pylist())
            counts = np.array([len(x) for x in got], np.int64)
            ids = np.array([i for x in got for i in x], self.type)
        ends = np.cumsum(counts)
        ids = np.insert(ids.astype(self.type, copy=False), ends, self.end_id).tobytes()
        cuts = [0, *((ends + np.arange(1, len(ends) + 1)) * np.dtype(self.type).itemsize).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def _encoder(*key) -> Encoder:
    return worker_state(("encoder", key), lambda: Encoder(*key))


def _train(samples: list[bytes]) -> bytes:
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples: their bytes serve as a raw dictionary
        return b"".join(samples)[:DICT_BYTES]


def _dict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write the file set to ``path``.

    A null text is empty and has the end id only. Documents come in ascending id, null ids first; rows that share
    an id follow each other in the order of their frames. An empty table writes a dictionary and no blocks. Other
    columns of ``docs`` are ignored, whatever their names.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    short = rows.where(F.octet_length("text") <= SAMPLE_BYTES).withColumn("h", F.xxhash64(F.lit(5), "id", "text"))
    # Hashes first: the texts of the sample alone travel.
    least = F.broadcast(short.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS))
    sample = [r["text"] for r in short.join(least, "h").select("h", "text").dropDuplicates(["h"]).orderBy("h").collect()]
    trained = _train(_encoder(tokenizer_path, end_id, width).encode(pa.array(sample, pa.string())))
    sha = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(sha, bytearray(trained), width)], "sha256 string, bytes binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches):
        enc, comp = _encoder(tokenizer_path, end_id, width), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(trained))
        for big in batches:
            for batch in text_slices(big, text_bytes=SLICE_BYTES):
                ids = enc.encode(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([comp.compress(x) for x in ids], pa.binary())], ["id", "n", "frame"])

    frames_path = new_path(spark, "frames")
    rows.mapInArrow(encode, "id long, n long, frame binary").write.parquet(frames_path)

    def pack(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            ids, counts, frames = zip(*held)
            ends = np.cumsum([len(f) for f in frames])
            known = [i for i in ids if i is not None]
            return pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "first_id": known[0] if known else None, "last_id": known[-1] if known else None, "n_tokens": sum(counts), "dict_sha256": sha,
                "doc_ids": list(ids), "counts": list(counts), "offsets": [0, *ends.tolist()], "payload": b"".join(frames)}], schema=block_schema)

        for batch in batches:
            for i, n, f in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "frame"))):
                held.append((i, n, f))
                size += len(f)
                if size >= BLOCK_BYTES:
                    yield block()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield block()

    block_schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_tokens", pa.int64()), ("dict_sha256", pa.string()),
                              ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
    frames = spark.read.schema("id long, n long, frame binary").parquet(frames_path)
    frames.repartitionByRange("id").sortWithinPartitions(F.col("id").asc_nulls_first(), "frame").mapInArrow(
        pack, "part int, seq int, first_id long, last_id long, n_tokens long, dict_sha256 string, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary",
    ).write.parquet(f"{path}/blocks")
    delete_path(spark, frames_path)


def _dictionary(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/dictionary").first()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a file set: doc_id, start, n_tokens, ids (little-endian bytes), ids_crc32.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over ids of 32 bits. The ids are
    decompressed from the files and the dictionary named in each block.
    """
    d = _dictionary(spark, path)
    trained, sha, width = bytes(d["bytes"]), d["sha256"], d["width"]

    def decode(batches):
        out = zstandard.ZstdDecompressor(dict_data=_dict(trained))
        for batch in batches:
            for r in batch.to_pylist():
                if r["dict_sha256"] != sha:
                    raise ValueError("a block was written with another dictionary")
                ids = [out.decompress(r["payload"][a:b]) for a, b in zip(r["offsets"], r["offsets"][1:])]
                before = np.cumsum([0, *r["counts"]])[:-1]
                crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(ids), pa.int32()), pa.array([r["seq"]] * len(ids), pa.int32()), pa.array(r["doc_ids"], pa.int64()),
                     pa.array(before, pa.int64()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "before", "n_tokens", "ids", "ids_crc32"])

    blocks = spark.read.parquet(f"{path}/blocks")
    docs = blocks.mapInArrow(decode, "part int, seq int, doc_id long, before long, n_tokens long, ids binary, ids_crc32 long")
    # Prefix sums on two levels: over parts, then over the blocks of a part.
    index = blocks.select("part", "seq", "n_tokens")
    prior = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(prior.orderBy("part")), F.lit(0)).alias("_p"))
    starts = index.join(parts, "part").select("part", "seq", (F.col("_p") + F.coalesce(F.sum("n_tokens").over(prior.partitionBy("part").orderBy("seq")), F.lit(0))).alias("_start"))
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row with its id), read from its own frames only."""
    d = _dictionary(spark, path)
    hits = spark.read.parquet(f"{path}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    at = hits.select("dict_sha256", F.explode(F.arrays_zip("doc_ids", F.sequence(F.lit(1), F.size("doc_ids")).alias("k"))).alias("z"), "offsets", "payload").where(F.col("z.doc_ids") == doc_id)
    k = F.col("z")["k"]
    start = F.element_at("offsets", k)
    frames = at.select(F.substring("payload", start.cast("int") + 1, (F.element_at("offsets", k + 1) - start).cast("int")).alias("f")).collect()
    out = zstandard.ZstdDecompressor(dict_data=_dict(bytes(d["bytes"])))
    return [np.frombuffer(out.decompress(bytes(r["f"])), f"<u{d['width']}").tolist() for r in frames]
