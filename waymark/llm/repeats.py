"""Exact search for windows of fixed length that occur again anywhere in a corpus, sparse in memory and shuffle.

A text is a sequence of symbols (bytes, or words) with a 64-bit code each. Every window of `size` symbols picks the
least hash among its `gram`-symbol grams as its anchor (leftmost on ties), so equal windows have equal anchors at equal
offsets, wherever they stand. Consecutive windows with one anchor are a *run*; runs, a hundredth of the
windows or so, are what Spark shuffles. The runs of one slice of texts that have equal content are one row with their
places, so a passage in a third of all texts is a row for each slice, not for each text, in every join; what is found
goes back to the slices, which tell their texts' spans:

* anchors that occur once end there;
* two runs with equal content repeat each other in all their windows at once;
* of runs that share an anchor but not their content (the edges of passages), each different content is looked at
  once, however often it occurs: window by window or, where a window has a `block`, block by block. A block is the
  windows of `block` neighbouring offsets from the anchor. They share a core; if no other block has it, none of them
  occurs again. Otherwise they differ only in the few symbols before and after the core, which the block carries
  along, so that single windows are told apart without the text.

Each count is a grouped aggregate with partial sums, so a passage in a third of all texts is a few rows for each
task. Equality is that of 64-bit hashes. Texts are taken whole; windows never cross texts. Null or short texts have
no windows. Rows with a null doc_id take no part. A row's key is a hash of its doc_id and text, so rows that repeat a
doc_id count as further texts, and equal rows have equal spans.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .scratch import likely_in, written_by_size

U64 = np.uint64
LOW = U64(0xFFFFFFFF)


def byte_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = tn.text_bytes(column)
    return tn.BYTE_CODE[data], bounds


@dataclass(frozen=True)
class Windows:
    """What a window is: its length, the length of the grams that anchor it, and how a text becomes symbol codes."""

    size: int
    gram: int
    codes: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    block: int = 0


BYTES_200 = Windows(200, 40, byte_codes, 32)
WORDS_50 = Windows(50, 8, tn.word_hashes)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchored_runs(codes: np.ndarray, bounds: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, the anchor's distance, anchor hash, content hash) of every run."""
    if len(codes) < w.size:
        return (np.zeros(0, np.int64),) * 6
    prefix = tn.prefix_hash(codes)
    grams = tn.window_hash(prefix, w.gram)
    least = sliding_min((grams & ~LOW) | np.arange(len(grams), dtype=U64), w.size - w.gram + 1)
    valid = np.zeros(len(codes) + 1, np.int8)
    long = bounds[1:] - bounds[:-1] >= w.size
    valid[bounds[:-1][long]] += 1
    valid[bounds[1:][long] - w.size + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid[: len(least)], dtype=np.int8))
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    anchor = (least[at] & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    start, anchor = at[first], anchor[first]
    n = np.diff(np.concatenate([first, [len(at)]]))
    content = tn.span_hash(prefix, start, start + n - 1 + w.size)
    content = tn.mix(content + (anchor - start).astype(U64) * U64(tn.BASE))
    text = np.searchsorted(bounds, start, "right") - 1
    return text, start - bounds[text], n, anchor - start, tn.signed(grams[anchor]), tn.signed(content)


PLACE = pa.struct([("order", pa.int64()), ("row", pa.int64()), ("pos", pa.int64())])
RUN_ROW = "slice bigint, anchor bigint, content bigint, n int, lead int, places array<struct<order: bigint, row: bigint, pos: bigint>>"


def _run_rows(w: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of a slice of texts, one row for each content. A slice is named by its first text's key."""
        tn.kept_by("repeats")
        for batch in batches:
            for part, texts in tn.slices(batch):
                text, pos, n, lead, anchor, content = anchored_runs(*w.codes(texts), w)
                at = np.lexsort((content, anchor))
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(anchor[at]) != 0) | (np.diff(content[at]) != 0)
                bounds, first = np.append(np.flatnonzero(new), len(at)), at[new]
                order, row = (part.column(part.schema.get_field_index(c)) for c in ("order", "row"))
                places = pa.StructArray.from_arrays([order.take(pa.array(text[at])), row.take(pa.array(text[at])), pa.array(pos[at])], fields=list(PLACE))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), row[0].as_py())), pa.array(anchor[first]), pa.array(content[first]), pa.array(n[first], pa.int32()), pa.array(lead[first], pa.int32())]
                    + [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), places)],
                    names=["slice", "anchor", "content", "n", "lead", "places"],
                )

    return run


def _window_rows(w: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of the runs that `marks` names, one row each."""
        tn.kept_by("repeats")
        for batch in batches:
            for part, texts in tn.slices(batch):
                codes, bounds = w.codes(texts)
                hashes = tn.signed(tn.window_hash(tn.prefix_hash(codes), w.size))
                marks = part.column(part.schema.get_field_index("marks"))
                text = np.repeat(np.arange(len(part)), np.diff(marks.offsets.to_numpy()))
                flat = marks.flatten()
                pos, n = (flat.field(c).to_numpy() for c in ("pos", "n"))
                row = np.repeat(np.arange(len(n)), n)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[(bounds[text] + pos)[row] + offset])]
                    + [flat.field(c).take(pa.array(row)) for c in ("anchor", "content", "times")]
                    + [part.column(part.schema.get_field_index("order")).take(pa.array(text[row])), pa.array(offset, pa.int32())],
                    names=["window", "anchor", "content", "times", "order", "offset"],
                )

    return run


def _block_rows(w: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of the runs (of bytes) that `marks` names, one row each."""
        tn.kept_by("repeats")
        size, width = w.size, w.block
        for batch in batches:
            for part, texts in tn.slices(batch):
                data, bounds = tn.text_bytes(texts)
                prefix, raw = tn.prefix_hash(w.codes(texts)[0]), data.tobytes()
                marks = part.column(part.schema.get_field_index("marks"))
                text = np.repeat(np.arange(len(part)), np.diff(marks.offsets.to_numpy()))
                flat = marks.flatten()
                pos, n, lead = (flat.field(c).to_numpy().astype(np.int64) for c in ("pos", "n", "lead"))
                low, high = -lead // width, (n - 1 - lead) // width
                row = np.repeat(np.arange(len(n)), high - low + 1)
                b = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
                base = (bounds[text] + pos + lead)[row] + b * width
                t0, t1 = np.maximum(0, -lead[row] - b * width), np.minimum(width - 1, (n - 1 - lead)[row] - b * width)
                core = tn.span_hash(prefix, base + width - 1, base + size)
                whole = tn.span_hash(prefix, base + t0, base + size + t1)
                whole = tn.mix(whole + ((b + 64) * 4096 + t0 * 64 + t1).astype(U64) * U64(tn.BASE))
                left = [raw[i:j] for i, j in zip((base + t0).tolist(), (base + width - 1).tolist(), strict=True)]
                right = [raw[i:j] for i, j in zip((base + size).tolist(), (base + size + t1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [flat.field(c).take(pa.array(row)) for c in ("anchor", "content", "times")]
                    + [pa.array(x, pa.int32()) for x in (b, t0, t1, b * width + lead[row])]
                    + [pa.array(tn.signed(core)), pa.array(tn.signed(whole)), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    names=["anchor", "content", "times", "b", "t0", "t1", "at", "core", "whole", "left", "right"],
                )

    return run


BLOCK_ROW = "anchor bigint, content bigint, times bigint, b int, t0 int, t1 int, at int, core bigint, whole bigint, left binary, right binary"


def _again_by_blocks(texts: DataFrame, w: Windows) -> DataFrame:
    """(anchor, content, at, mask): windows of unrepeated runs that occur again, `mask` having a bit for each from `at`."""
    blocks = written_by_size(texts.mapInArrow(_block_rows(w), BLOCK_ROW), "blocks")
    place = ["anchor", "b", "core"]
    cores = blocks.groupBy(*place).agg(F.sum("times").alias("met"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
    cores = cores.where("met > 1").select(*place, (F.col("lo") < F.col("hi")).alias("mixed"))
    blocks = written_by_size(blocks.join(cores, place), "met")
    span = F.expr("shiftleft(1L, t1 + 1) - shiftleft(1L, t0)")
    plain = blocks.where("times = 1 and not mixed").select("anchor", "content", "at", span.alias("mask"))

    edge = [*place, "whole"]
    kinds = blocks.where("mixed").groupBy(*edge).agg(F.sum("times").alias("times"), *[F.first(c).alias(c) for c in ("t0", "t1", "left", "right")])
    kinds = written_by_size(kinds, "kinds")
    windows = kinds.select(*edge, "times", F.explode(F.sequence("t0", "t1")).alias("t"), "t0", "left", "right")
    before = F.expr(f"substring(left, t - t0 + 1, {w.block - 1} - t)")
    after = F.expr("substring(right, 1, t)")
    windows = windows.select(*edge, "times", "t", F.xxhash64(*place, "t", before, after).alias("window"))
    often = windows.groupBy("window").agg(F.sum("times").alias("met")).where("met > 1").select("window")
    masks = windows.where("times = 1").join(often, "window").groupBy(*edge).agg(F.sum(F.expr("shiftleft(1L, t)")).alias("mask"))
    masks = masks.union(kinds.where("times > 1").select(*edge, span.alias("mask")))
    mixed = blocks.where("times = 1 and mixed").join(masks, edge).select("anchor", "content", "at", "mask")
    return plain.union(mixed)


def _offsets(parts: list) -> np.ndarray:
    """The windows that the parts' masks have bits for."""
    return np.array([p["at"] + i for p in parts for i in range(int(p["mask"]).bit_length()) if p["mask"] >> i & 1], np.int64)


def _merge(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Maximal removal intervals of each text of a slice from the starts of its repeated windows."""
        for batch in batches:
            for marks in batch.column("marks"):
                gone = defaultdict(list)
                for m in marks.as_py():
                    whole = np.arange(m["n"])
                    some = _offsets(m["parts"] or [])
                    for p in m["places"]:
                        starts = whole if p["order"] != m["spared"] else some
                        if len(starts):
                            gone[p["row"]].append(p["pos"] + starts)
                out = []
                for found in gone.values():
                    starts = np.unique(np.concatenate(found))
                    cut = np.flatnonzero(np.diff(starts) > size) + 1
                    out.append([{"start": int(s[0]), "end": int(s[-1]) + size} for s in np.split(starts, cut)])
                spans = pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(list(gone), pa.int64()), spans], names=["row", "spans"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and row, a key of their values (null for a null doc_id)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))


def repeated_spans(docs: DataFrame, w: Windows, keep_first: bool) -> DataFrame:
    """(row, spans array<struct<start, end>>) of the texts in which something is repeated, in symbols of the text.

    docs: as `keyed` gives them.
    keep_first False: windows that start anywhere else too, in the same text or another.
    keep_first True: windows that start in a text with a smaller doc_id.
    """
    order = F.col("doc_id") if keep_first else F.lit(0).cast("bigint")
    docs = docs.where("row is not null").select("row", order.alias("order"), "text")
    runs = written_by_size(docs.mapInArrow(_run_rows(w), RUN_ROW), "runs")
    times = F.sum(F.size("places")).alias("times")
    anchors = runs.groupBy("anchor").agg(times, F.min("content").alias("lo"), F.max("content").alias("hi"))
    # written first, so that the join after it is a plain one whose hot keys Spark can split
    anchors = written_by_size(anchors.where("times > 1").select("anchor", (F.col("lo") < F.col("hi")).alias("several")), "anchors")
    runs = written_by_size(runs.join(anchors, "anchor"), "repeated")

    first = F.min(F.array_min("places")).alias("first")
    contents = runs.groupBy("anchor", "content").agg(times, first, F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("several").alias("several"))
    contents = written_by_size(contents.select("anchor", "content", "times", "first.*", "n", "lead", "several"), "contents")
    edges = contents.where("several").groupBy("row").agg(F.collect_list(F.struct("pos", "n", "lead", "anchor", "content", "times")).alias("marks"))
    edges = written_by_size(edges, "edges")
    texts = likely_in(docs, "row", edges.select("row")).join(edges, "row").dropDuplicates(["row"])
    if w.block and not keep_first:
        again = _again_by_blocks(texts, w)
    else:
        schema = "window bigint, anchor bigint, content bigint, times bigint, order bigint, offset int"
        windows = written_by_size(texts.mapInArrow(_window_rows(w), schema), "windows")
        counts = windows.groupBy("window").agg(F.sum("times").alias("all_times"), F.min("order").alias("least"))
        if keep_first:
            again = windows.join(counts.select("window", "least"), "window").where("least < order")
        else:
            again = windows.where("times = 1").join(counts.where("all_times > 1").select("window"), "window")
        again = again.select("anchor", "content", F.col("offset").alias("at"), F.lit(1).cast("bigint").alias("mask"))
    partly = again.groupBy("anchor", "content").agg(F.collect_list(F.struct("at", "mask")).alias("parts"))

    # runs go wholly but for those of the order `spared`, of which the windows in `parts` go
    spared = F.col("order") if keep_first else F.when(F.col("times") == 1, F.col("order"))
    known = contents.join(partly, ["anchor", "content"], "left").where(F.col("parts").isNotNull() | (F.col("times") > 1))
    # written first, so that the join after it is a plain one
    known = written_by_size(known.select("anchor", "content", spared.alias("spared"), "parts"), "known")
    marked = runs.select("slice", "anchor", "content", "n", "places").join(known, ["anchor", "content"])
    marks = marked.groupBy("slice").agg(F.collect_list(F.struct("n", "places", "spared", "parts")).alias("marks")).select("marks")
    spans = marks.mapInArrow(_merge(w.size), "row bigint, spans array<struct<start: bigint, end: bigint>>")
    return written_by_size(spans.dropDuplicates(["row"]), "spans")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row for each key of docs that has spans, with them; other texts aren't shuffled. Spans may be many, so none are broadcast."""
    return likely_in(docs, "row", spans.select("row")).join(spans.hint("merge"), "row").dropDuplicates(["row"])
