"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

1. One pass turns each whole text into a short vector of statistics (byte classes, word lengths, repetition).
2. Random Fourier features cos(w.x + b) of the standardised statistics approximate a Gaussian kernel. Each partition of the
   labelled rows sums its part of the normal equations; Spark adds the parts, the driver solves one system whose
   size is the number of features.
3. Scores of other labelled rows, counted by Spark in fixed bins, are made monotone (pool adjacent violators).
4. Every document is scored from its statistics.

Labels are learned from rows whose crc32(doc_id as text) mod 4 is not 2: folds 0 and 1 fit the ridge, fold 3 the
calibration. The fit uses at most FIT_ROWS labelled rows (those with the least hash of doc_id); scoring covers all rows.
Null and empty texts have all-zero statistics and get a score like any other; without labels every score is 0.5.
Rows with a null doc_id are scored and count as not held out. Repeated rows are scored alike. Labels whose quality is
null are ignored; other columns are carried by the filter and ignored by the scorer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .scratch import without_rows, written

FEATURES, RIDGE, SEED, BINS, ACCEPT = 256, 1e-3, 4, 1000, 0.7
#: Bandwidth of the kernel, in standard deviations times the root of the number of statistics.
WIDTH = 1.0
FIT_ROWS = 400_000

_CLASS = np.full(256, 11, np.uint8)  # other ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
for _i, _chars in enumerate((b" \t\r\x0b\x0c", b"\n", b".,;:'\"-()?", b"!", b"|", b"*$#%&@^~+=<>_\\/", b"{}[]`"), 4):
    _CLASS[list(_chars)] = _i
N_CLASSES = 12
N_STATS = N_CLASSES + 10


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of N_STATS numbers for each text, from all of it."""
    data, bounds = tn.text_bytes(texts)
    n = len(texts)
    out = np.zeros((n, N_STATS))
    if not len(data):
        return out
    size = np.diff(bounds)
    of = np.repeat(np.arange(n), size)
    counts = np.bincount(of * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out[:, :N_CLASSES] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    starts, ends, words = tn.word_spans(data, bounds)
    length, number = ends - starts, np.diff(words)
    word_of = np.repeat(np.arange(n), number)
    many = np.maximum(number, 1)
    mean = np.bincount(word_of, length, n) / many
    prefix = tn.prefix_hash(tn.FOLDED_CODE[data])
    hashes = tn.span_hash(prefix, starts, ends)
    lines = np.flatnonzero(data == 10)
    line_ends = np.unique(np.concatenate([lines, bounds[1:]]))
    line_starts = np.concatenate([[0], line_ends[:-1]])
    line_of = np.searchsorted(bounds, line_starts, "right") - 1
    keep = (line_ends - line_starts > 2) & (line_of < n)
    line_hash, line_of = tn.span_hash(prefix, np.minimum(line_starts + (data[np.minimum(line_starts, len(data) - 1)] == 10), line_ends), line_ends)[keep], line_of[keep]
    line_bounds = np.searchsorted(line_of, np.arange(n + 1))

    k = N_CLASSES
    out[:, k] = np.log1p(size)
    out[:, k + 1] = mean
    out[:, k + 2] = np.sqrt(np.maximum(np.bincount(word_of, length.astype(float) ** 2, n) / many - mean**2, 0))
    out[:, k + 3] = np.bincount(word_of, length <= 3, n) / many
    out[:, k + 4] = np.bincount(word_of, length >= 9, n) / many
    last = _CLASS[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    out[:, k + 5] = np.bincount(word_of, last == 9, n) / many
    out[:, k + 6] = np.bincount(word_of, last == 6, n) / many
    for i in range(n):
        h = hashes[words[i] : words[i + 1]]
        if len(h) > 2:
            out[i, k + 7] = len(np.unique(h)) / len(h) ** 0.9
            triple = h[:-2] * tn.U64(3) + h[1:-1] * tn.U64(5) + h[2:] * tn.U64(7)
            out[i, k + 8] = 1 - len(np.unique(triple)) / len(triple)
        own = line_hash[line_bounds[i] : line_bounds[i + 1]]
        out[i, k + 9] = 1 - len(np.unique(own)) / len(own) if len(own) else 0
    return out


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tn.kept_by("quality")
    for batch in batches:
        for part, texts in tn.slices(batch):
            stats = pa.array(statistics(texts).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in ("doc_id", "row")), stats], names=["doc_id", "row", "stats"])


def row_key(docs: DataFrame) -> F.Column:
    """A hash of doc_id and text: rows that share a doc_id are judged each by its own text."""
    return F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, row (see row_key), stats."""
    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), row_key(docs).alias("row"), "text")
    return keyed.mapInArrow(_stat_rows, "doc_id bigint, row bigint, stats array<double>")


class Kernel:
    """Random Fourier features of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.standard_normal((len(mean), FEATURES)) / (WIDTH * np.sqrt(len(mean)))
        self.b = rng.random(FEATURES) * 2 * np.pi

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.deviation, -6, 6)
        return np.concatenate([np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))], axis=1)


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), N_STATS)


def _normal_equations(kernel: Kernel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """This partition's sums of z z' and z y, one row for each row of the matrix."""
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z, y = kernel(_stats_of(batch)), batch.column("quality").to_numpy(zero_copy_only=False)
            total += z.T @ np.concatenate([z, y[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "sums"])

    return run


def _raw_scores(kernel: Kernel, weights: np.ndarray, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = kernel(_stats_of(batch)) @ weights
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + [pa.array(raw)], names=[*carried, "raw"])

    return run


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins in order: the non-decreasing share of ones nearest to the bins' own."""
    blocks: list[list[float]] = []
    for n, y in zip(total.tolist(), ones.tolist(), strict=True):
        blocks.append([n, y, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, y2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + y2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), y / n if n else np.nan) for n, y, k in blocks])


def fold(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


class QualityModel:
    def __init__(self, kernel: Kernel | None, weights: np.ndarray | None, curve: list[float]):
        self.kernel, self.weights, self.curve = kernel, weights, curve

    def score(self, stats: DataFrame) -> DataFrame:
        """(doc_id, row, score) from (doc_id, row, stats); at equal calibrated values the raw score still orders."""
        if self.kernel is None:
            return stats.select("doc_id", "row", F.lit(self.curve[0]).alias("score"))
        raw = stats.mapInArrow(_raw_scores(self.kernel, self.weights, ["doc_id", "row"]), "doc_id bigint, row bigint, raw double")
        at = _bin(F.col("raw"))
        curve = F.array(*[F.lit(float(c)) for c in self.curve])
        level = F.element_at(curve, at + 1)
        squashed = F.least(F.greatest((F.col("raw") + 1) / 3, F.lit(0.0)), F.lit(1.0))
        return raw.select("doc_id", "row", (level * 0.998 + squashed * 0.002).alias("score"))


def _bin(raw) -> F.Column:
    return F.least(F.greatest(F.floor((raw + 1) * (BINS / 3)), F.lit(0)), F.lit(BINS - 1)).cast("int")


def fit_quality(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """A model from document statistics and labels (doc_id, quality)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("quality").cast("double")).alias("quality"))
    known = known.withColumn("fold", fold("doc_id")).where("fold != 2").orderBy(F.xxhash64("doc_id")).limit(FIT_ROWS)
    rows = written(stats.join(known, "doc_id").select("stats", "quality", "fold"), "labelled")
    spread = rows.agg(F.count("*"), F.avg("quality"), *[f(F.col("stats")[i]) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
    if not spread[0] or spread[1] in (0.0, 1.0):
        return QualityModel(None, None, [0.5 if not spread[0] else spread[1]])
    moments = np.array(spread[2:], float).reshape(N_STATS, 2)
    kernel = Kernel(moments[:, 0], moments[:, 1])
    sums = rows.where("fold != 3").mapInArrow(_normal_equations(kernel), "i bigint, sums array<double>")
    sums = sums.select("i", F.posexplode("sums").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    sums = sums.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("row")).collect()
    total = np.array([r["row"] for r in sorted(sums, key=lambda r: r["i"])]) if sums else np.zeros((FEATURES + 1, FEATURES + 2))
    n = max(total[-1, FEATURES], 1)
    weights = np.linalg.solve(total[:, :-1] / n + RIDGE / FEATURES * np.eye(FEATURES + 1), total[:, -1] / n)
    raw = rows.where("fold = 3").mapInArrow(_raw_scores(kernel, weights, ["quality"]), "quality double, raw double")
    bins = raw.groupBy(_bin(F.col("raw")).alias("bin")).agg(F.count("*").alias("n"), F.sum("quality").alias("y")).collect()
    bins.sort(key=lambda b: b["bin"])
    if not bins:
        return QualityModel(kernel, weights, (np.arange(BINS) * 3 / BINS - 1).clip(0, 1).tolist())
    level = isotonic(np.array([b["n"] for b in bins], float), np.array([b["y"] for b in bins], float))
    curve = np.interp(np.arange(BINS), [b["bin"] for b in bins], level)
    return QualityModel(kernel, weights, curve.tolist())


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    stats = written(document_statistics(docs), "stats")
    scored = fit_quality(stats, labels).score(stats)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, unchanged. Texts aren't shuffled: the model scores them in place."""
    stats = written(document_statistics(docs), "stats")
    model = fit_quality(stats, labels)
    return without_rows(docs, row_key(docs), model.score(stats).where(F.col("score") < ACCEPT).select("row").distinct())


__all__ = ["QualityModel", "fit_quality", "keep_good", "score_quality"]
