"""Exact byte-level dedup: every byte covered by a 200-byte string that also starts elsewhere goes.

Prefix doubling over all positions would sort a row for each byte several times; it isn't done here, and no rank or suffix array
is made. Windows of 200 bytes are grouped by an anchor that equal windows share (see repeats.py): runs of windows whose
anchor, of 40 bytes, is unique drop out; runs with equal content repeat as a whole; only what is then neither unique
nor settled is looked at by blocks of neighbouring windows, and window by window. Spark groups and counts in each step.

Null texts are empty; texts under 200 bytes and rows with a null doc_id lose nothing; overlapping repeats and repeats
within one text count; long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .repeats import BYTES_200, keyed, repeated_spans, with_spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in tn.slices(batch):
            data, bounds = tn.text_bytes(texts)
            raw = data.tobytes()
            kept, removed, runs = [], [], []
            for i, spans in enumerate(part.column(part.schema.get_field_index("spans")).to_pylist()):
                own, at, pieces = raw[bounds[i] : bounds[i + 1]], 0, []
                for s in spans:
                    pieces.append(own[at : s["start"]])
                    at = s["end"]
                kept.append(b"".join([*pieces, own[at:]]))
                removed.append(len(own) - len(kept[-1]))
                runs.append(len(spans))
            sha = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
            row = part.column(part.schema.get_field_index("row"))
            yield pa.RecordBatch.from_arrays([row, pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), sha], names=["row", "n_removed", "n_spans", "kept", "kept_sha256"])


def cut_repeated_bytes(docs: DataFrame) -> DataFrame:
    """row (the key that `keyed` gives), n_removed, n_spans, kept (bytes) and its SHA-256, of the texts that lose bytes."""
    docs = keyed(docs)
    schema = "row bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
    return with_spans(docs, repeated_spans(docs, BYTES_200, keep_first=False)).mapInArrow(_cut, schema)


def suffix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every text."""
    text = F.coalesce("text", F.lit(""))
    plain = keyed(docs).select("doc_id", "row", F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    cut = cut_repeated_bytes(docs).drop("kept")
    zero = F.lit(0).cast("bigint")
    return plain.join(cut, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )


__all__ = ["cut_repeated_bytes", "suffix_digest"]
