"""Token-ID output: documents as one concatenated id array with Elias-Fano coded document boundaries.

File format. A table of *segments* in Parquet, in ascending order of doc_id (nulls first): `part` and `seq` order them,
`doc_ids` names their documents, `n_tokens` counts their ids, and `segment` is the payload:

    magic WTID, version, bytes of an id (2 or 4), documents, ids       <4sHHQQ
    low bits l, bytes of the low part, bytes of the high part, samples <BxxxIII
    low part, high part, select samples (uint32), ids (little-endian)

The ends of the documents within a segment are a growing sequence e[0..n): the l low bits of each are packed, and the
high parts are a bit array with bit (e[i] >> l) + i set. Readers take offsets by select, which finds the i-th set bit from a sample every 256 ones and a
popcount over the bytes between, so any offset costs a bounded read and boundaries take about 2 + l bits each; no table
of 64-bit offsets is stored. A segment ends after SEGMENT_IDS ids (a longer document has its own).

Null texts are empty; every document gets the end id; ties of doc_id stay side by side in any order; an empty table gives
no segments; other columns are ignored; texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD, SIZES = struct.Struct("<4sHHQQ"), struct.Struct("<BxxxIII")
MAGIC, VERSION = b"WTID", 1
SAMPLE = 256
SEGMENT_IDS = 1 << 18
#: Encoded parts of texts that a worker remembers; forgetting them all costs time only.
MEMO_WORDS = 600_000
POPCOUNT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence of unsigned integers with select in place."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, *(np.zeros(0, t) for t in (np.uint8, np.uint8, np.uint32)))
        values = values.astype(np.uint64)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        low = np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value, from one sample and the bytes after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        left += int(POPCOUNT[self.high[byte] & ((1 << at % 8) - 1)])
        step = 64
        while True:
            counts = np.cumsum(POPCOUNT[self.high[byte : byte + step]])
            if counts[-1] > left:
                break
            left -= int(counts[-1])
            byte += step
        inside = int(np.searchsorted(counts, left, "right"))
        left -= int(counts[inside - 1]) if inside else 0
        bit = int(np.flatnonzero(np.unpackbits(self.high[byte + inside : byte + inside + 1], bitorder="little"))[left])
        value = ((byte + inside) * 8 + bit - i) << self.low_bits
        for b in range(self.low_bits):
            j = i * self.low_bits + b
            value |= int(self.low[j // 8] >> j % 8 & 1) << b
        return value

    def all(self) -> np.ndarray:
        """Every value, as int64."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (ones - np.arange(self.n) << self.low_bits) | (low << np.arange(self.low_bits)).sum(axis=1)


def pack(ids: bytes, width: int, ends: np.ndarray) -> bytes:
    ef = EliasFano.of(ends)
    head = HEAD.pack(MAGIC, VERSION, width, ef.n, len(ids) // width)
    sizes = SIZES.pack(ef.low_bits, len(ef.low), len(ef.high), len(ef.samples))
    return b"".join([head, sizes, ef.low.tobytes(), ef.high.tobytes(), ef.samples.astype("<u4").tobytes(), ids])


def unpack(segment: bytes) -> tuple[EliasFano, np.ndarray]:
    """The boundaries and the ids (uint16 or uint32, a view of the bytes)."""
    magic, version, width, n, n_ids = HEAD.unpack_from(segment)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token segment")
    bits, low, high, samples = SIZES.unpack_from(segment, HEAD.size)
    at = HEAD.size + SIZES.size
    parts = [np.frombuffer(segment, np.uint8, low, at), np.frombuffer(segment, np.uint8, high, at + low)]
    at += low + high
    parts.append(np.frombuffer(segment, "<u4", samples, at))
    return EliasFano(n, bits, *parts), np.frombuffer(segment, f"<u{width}", n_ids, at + 4 * samples)


#: Normalisation and splitting that Words knows how to cut texts for: NFC, white space to a space, lower case; then
#: contractions, runs of letters, single digits, runs of others.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = r"\x20\t-\r"
#: Letters beyond ASCII that normalisation leaves as they are but for their case, one by one.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"


def text_cut(told: dict) -> tuple[re.Pattern, re.Pattern, re.Pattern] | None:
    """Patterns of what is unclear, and of the parts of texts without and with it, for a tokenizer file that works as known."""
    steps = [n.get("type") for n in (told["normalizer"] or {}).get("normalizers", [])]
    first, *others = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    added = [t["content"] for t in told["added_tokens"]]
    known = steps == NORMALIZERS and first.get("pattern") == {"Regex": SPLIT} and [o.get("type") for o in others] == ["ByteLevel"]
    if not known or told["post_processor"] or told["truncation"] or told["padding"] or any(re.search(r"\s", t) for t in added):
        return None
    unclear = "|".join([f"[^\\x00-\\x7f{_LATIN}]", *map(re.escape, added)])
    letters = f"A-Za-z{_LATIN}"
    clear = f"'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[{letters}]+|[0-9]|[^{_SPACE}{letters}0-9]+"
    return re.compile(unclear), re.compile(clear), re.compile(f"[^{_SPACE}]*?(?:{unclear})[^{_SPACE}]*|{clear}")


class Words:
    """One tokenizer, loaded once for a worker, with the ids of the parts of texts met so far.

    Texts are cut where the tokenizer cuts them anyway, so that their ids are those of the parts, each encoded once. A word
    with characters of unclear standing, or with an added token's text, is a part as a whole. A tokenizer that
    works in another way encodes whole texts.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.memo: dict[str, bytes] = {}
        self.cut = text_cut(json.loads(self.tokenizer.to_str()))
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian bytes."""
        if self.cut is None:
            return [np.array(e.ids, self.kind).tobytes() for e in self.encode(texts, add_special_tokens=False)]
        unclear, clear, mixed = self.cut
        parts = [(mixed if unclear.search(t) else clear).findall(t) for t in texts]
        new = list(set().union(*parts).difference(self.memo))
        model, plain = self.tokenizer.model, []
        other = []
        for part in new:
            (plain if _PLAIN.fullmatch(part) else other).append(part)
        for part in plain:  # the model's own symbols: nothing is left for the steps before it but the case
            self.memo[part] = array(_ARRAY[self.width], [t.id for t in model.tokenize(part.lower())]).tobytes()
        for at in range(0, len(other), 4096):
            some = other[at : at + 4096]
            for part, e in zip(some, self.encode(some, add_special_tokens=False), strict=True):
                self.memo[part] = array(_ARRAY[self.width], e.ids).tobytes()
        out = [b"".join(map(self.memo.__getitem__, p)) for p in parts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        return out


_PLAIN = re.compile("[A-Za-z]+|[0-9]")
_ARRAY = {2: "H", 4: "I"}
_words: dict[tuple[str, int], Words] = {}


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (path, end_id) not in _words:
            _words[path, end_id] = Words(path, end_id)
        words = _words[path, end_id]
        width = words.width
        end = np.array([end_id], words.kind).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        pieces: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(p) // width for p in pieces])
            row = {"part": part, "seq": seq, "doc_ids": doc_ids, "n_tokens": size // width, "segment": pack(b"".join(pieces), width, ends)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("segment", pa.binary())]))

        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                texts = [t or "" for t in rows.column("text").to_pylist()]
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), words.ids(texts), strict=True):
                    if pieces and size + len(ids) > SEGMENT_IDS * width:
                        yield flush()
                        doc_ids, pieces, size, seq = [], [], 0, seq + 1
                    doc_ids.append(doc_id)
                    pieces.append(ids + end)
                    size += len(ids) + width
        if pieces:
            yield flush()

    return run


def write_token_ids(docs: DataFrame, out: str, tokenizer_path: str, end_id: int) -> None:
    """Writes the segments of all documents to `out`, a folder that executors share."""
    schema = "part int, seq int, doc_ids array<bigint>, n_tokens bigint, segment binary"
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_segments(tokenizer_path, end_id), schema).write.parquet(out)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            ef, ids = unpack(row["segment"])
            ends = np.array([ef.select(i) for i in range(ef.n)], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            wide = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], names=names)


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, seq, before): ids before each segment, by sums within parts and over the parts' totals."""
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("parts_before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = segments.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("own_before"))
    return own.join(parts, "part").select("part", "seq", (F.col("parts_before") + F.col("own_before")).alias("before"))


def read_token_ids(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    files = spark.read.parquet(path)
    schema = "part int, seq int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"
    docs = files.mapInArrow(_documents, schema)
    starts = segment_starts(files.select("part", "seq", "n_tokens"))
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ef, ids = unpack(row["segment"])
            ends = ef.all()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], names=["doc_id", "ids"])


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, ids array<int> with the end id, for training code that wants the ids themselves."""
    return spark.read.parquet(path).mapInArrow(_ids, "doc_id bigint, ids array<int>")


def _slice(doc_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ef, ids = unpack(row["segment"])
                found = [ids[ef.select(i - 1) if i else 0 : ef.select(i)].tolist() for i, d in enumerate(row["doc_ids"]) if d == doc_id]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def read_document(spark, path: str, doc_id: int) -> DataFrame:
    """doc_id, ids of one document: two selects in its segment, other boundaries aren't decoded."""
    return spark.read.parquet(path).where(F.array_contains("doc_ids", doc_id)).mapInArrow(_slice(doc_id), "doc_id bigint, ids array<int>")
