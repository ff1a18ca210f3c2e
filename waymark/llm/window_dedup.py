"""Substring dedup by words: Rabin-Karp hashes of every 50-word window, repeated windows merged into maximal intervals.

The rolling hashes of all windows are taken in numpy, the counting is Spark's (see repeats.py for how windows that
can't repeat are left out of the shuffle). A word is removed if it lies in a window whose words also start in a text
with a smaller doc_id. Null texts have no words; texts of fewer words than a window, and rows with a null doc_id, are
kept as they are; ties of a passage within one text stay; other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .repeats import WORDS_50, keyed, repeated_spans, with_spans
from .scratch import unused

#: White space that separates words, in Java's and SQL's regular expressions alike.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words kept, joined by one space, of texts with spans."""
    for batch in batches:
        for part, texts in tn.slices(batch):
            data, bounds = tn.text_bytes(texts)
            starts, ends, words = tn.word_spans(data, bounds)
            kept, removed, total = [], [], []
            raw = data.tobytes()
            for i, spans in enumerate(part.column(part.schema.get_field_index("spans")).to_pylist()):
                gone = np.zeros(words[i + 1] - words[i], bool)
                for s in spans:
                    gone[s["start"] : s["end"]] = True
                at = words[i] + np.flatnonzero(~gone)
                kept.append(b" ".join(raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)))
                removed.append(int(gone.sum()))
                total.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("row")), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                names=["row", "n_words", "n_removed", "kept", "kept_sha256"],
            )


def cut_repeats(docs: DataFrame) -> DataFrame:
    """row (the key that `keyed` gives), n_words, n_removed, kept (words joined by one space) and its SHA-256, of the
    texts that lose words."""
    docs = keyed(docs)
    schema = "row bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string"
    return with_spans(docs, repeated_spans(docs, WORDS_50, keep_first=True)).mapInArrow(_cut, schema)


def joined_words(text) -> F.Column:
    """A text's words joined by one space; '' for null. JVM-side."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_GAP, " "))


def dedup_windows(docs: DataFrame) -> DataFrame:
    """docs without repeated windows: same columns and rows; text changes only where words go, and n_chars with it."""
    row, kept = unused("_row", docs), unused("_kept", docs)
    cut = cut_repeats(docs).select(F.col("row").alias(row), F.col("kept").alias(kept))
    out = docs.join(cut, F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"]) == cut[row], "left")
    changed = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(kept).isNotNull(), F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def window_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every text."""
    words = joined_words(F.col("text"))
    plain = keyed(docs).select("doc_id", "row", words.alias("words"))
    count = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.translate("words", " ", "")) + 1)
    plain = plain.select("doc_id", "row", count.cast("bigint").alias("n_words"), F.sha2("words", 256).alias("sha"))
    cut = cut_repeats(docs).select("row", "n_removed", "kept_sha256")
    return plain.join(cut, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )
