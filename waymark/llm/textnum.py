"""Numpy hashing of whole Arrow batches of text: words, n-grams and windows without per-word Python.

Everything here runs inside a Spark task on one slice of rows at a time; a slice is cut by bytes, so memory
follows the slice (or a single longer text), never the partition.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are hashed at a time; a longer single text is taken whole.
SLICE_BYTES = 1 << 20
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
FOLDED_CODE = BYTE_CODE.copy()
FOLDED_CODE[65:91] = BYTE_CODE[97:123]  # A-Z count as a-z
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_kept: dict[str, dict] = {}


def kept_by(operator: str) -> dict:
    """What an operator's tasks keep in this worker for its later ones; what other operators have kept there goes.

    Workers outlive their tasks, so without this a model's tables would lie beside the next operator's data.
    """
    others = [name for name in _kept if name != operator and _kept[name]]
    for name in others:
        _kept[name].clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    return _kept.setdefault(operator, {})


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept, and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.array([1], U64)
        while len(have) < n:
            have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
        if len(have) <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """h[i] = sum of codes[j] * BASE**j for j < i; any span's hash follows by span_hash."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(BASE, len(codes)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of codes[start:end], mixed; a span's length takes part."""
    return mix((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start] + (end - start).astype(U64))


def window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """span_hash of every window of that size, by slices instead of index arrays."""
    n = max(0, len(prefix) - size)
    return mix((prefix[size : size + n] - prefix[:n]) * powers(INVERSE, len(prefix))[:n] + U64(size))


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of large strings; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the n + 1 bounds."""
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch with their texts, each of about `limit` bytes or of one row."""
    column = text_column(batch.column(batch.schema.get_field_index(text)))
    _, bounds = text_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at), column.slice(at, end - at)
        at = end


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words [^\\x20\\x09-\\x0D]+, and the n + 1 bounds of each text's words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(bounds), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(column: pa.Array, codes: np.ndarray = BYTE_CODE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for every word of the texts, and the n + 1 bounds of each text's words."""
    data, bounds = text_bytes(column)
    starts, ends, words = word_spans(data, bounds)
    return span_hash(prefix_hash(codes[data]), starts, ends), words


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)
