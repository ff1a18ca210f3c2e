"""N-gram Jaccard join: a self-join of documents in the metric space of their word-shingle sets.

Jaccard distance is a metric; cells, windows and settling below all follow from its triangle inequality.

1. Equal sets are one *node* (a 64-bit hash of the set), so exact copies cost nothing further.
2. Random Voronoi cells make the first cut. Nearly all documents are at distance 1 from any pivot document, so the pivots of
   this cut are shingles: under a random order of all shingles a set lies in the cell of its first shingle, and two
   sets share that cell with probability equal to their similarity. A cell here is named by `rows` such orders at once, and
   boundary documents are replicated into `cells` of them, as many as make the probability that a pair at the similarity
   asked for meets in none of them less than MISS. Their number doesn't depend on the text's length.
   In each cell a pivot document meets the others: pairs whose sketches (16 bits of each of some first shingles) agree
   as often as similar sets must become one *family*, a region of the join. What else shares a cell becomes a region too.
3. Regions are joined exactly by pivots. Distances of all sets to a few pivots are measured; sets that share a linked
   pivot, directly or through other sets, are connected and settled if theirs is the region's largest group. No pair of
   settled sets is needed, so copies aren't expanded into all pairs. Settled sets go to the Voronoi cell of their nearest
   pivot; an open set goes to the cell of its nearest pivot and, by the triangle inequality, to every cell whose
   pivot is at most 2 * (1-s) farther away. Within a cell open sets meet settled ones. Open sets among themselves are a
   smaller region, which joins recursively. Regions of up to LEAF sets do this within a task, larger ones in Spark.
4. Links become components.

Links are exact but for hashing: shingles are 64-bit hashes, and MISS bounds what cells and sketches lose of each pair.

Nulls and empty texts have the empty set, which links with nothing; repeated rows and ties fall into one node.
Rows with a null doc_id link with nothing and have a null component. Rows that share a doc_id with other rows count as
further texts. Long texts are taken whole. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .components import components
from .scratch import arrow_batches, likely_in, without_rows, written, written_by_size

U64 = np.uint64
#: Probability that a pair at the similarity asked for meets in no cell; the same again that its sketches disagree.
MISS = 1e-12
#: First shingles whose 16 bits make a sketch.
SKETCH = 128
#: Sets that one task compares in one piece.
LEAF = 512
PIVOTS = 8
#: Rows that carry their region's pivots along, in one Arrow batch.
WITH_PIVOTS = 32
#: Sets of one cell that may become a region of their own.
LARGE_CELL = 64


@dataclass(frozen=True)
class Cells:
    """`cells` cells of `rows` orders each, and the least number of sketch values that similar sets agree on."""

    rows: int
    cells: int
    agree: int

    @classmethod
    def of(cls, similarity: float, miss: float = MISS) -> Cells:
        rows = max(1, min(6, math.floor(math.log(0.4) / math.log(similarity)))) if similarity < 1 else 6
        p = similarity**rows
        cells = max(math.ceil(math.log(miss) / math.log1p(-p)) if p < 1 else 1, math.ceil(SKETCH / rows))
        below, agree = 0.0, 0
        while agree < SKETCH:  # the lower tail of a binomial distribution
            below += math.comb(SKETCH, agree) * similarity**agree * (1 - similarity) ** (SKETCH - agree)
            if below > miss:
                break
            agree += 1
        return cls(rows, cells, agree)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; fewer words than `words` are one shingle."""
    codes, bounds = tn.word_hashes(column, tn.FOLDED_CODE)
    prefix = tn.prefix_hash(codes)
    grams = tn.window_hash(prefix, words)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield tn.span_hash(prefix, np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, U64)


def set_hash(shingles: np.ndarray) -> int:
    """The node of a set as a signed 64-bit integer: a hash of its sum and size."""
    total = int(tn.mix(shingles + U64(0x51)).sum(dtype=U64)) + len(shingles) * tn.BASE
    return int(tn.signed(tn.mix(np.array([total & (1 << 64) - 1], U64)))[0])


def cell_keys(sets: list[np.ndarray], c: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Names of the cells (sets, cells) and sketches (sets, SKETCH) of sets that aren't empty."""
    starts = np.cumsum([0] + [len(s) for s in sets])[:-1]
    flat = np.concatenate(sets)
    salts = tn.mix(np.arange(1, c.rows * c.cells + 1, dtype=U64) * U64(tn.BASE)) | U64(1)
    names, sketch = np.zeros((len(sets), c.cells), U64), np.zeros((len(sets), SKETCH), np.uint16)
    for i, salt in enumerate(salts):
        first = np.minimum.reduceat(flat * salt, starts)
        names[:, i // c.rows] += tn.mix(first + U64(i))
        if i < SKETCH:
            sketch[:, i] = first * U64(tn.BASE) >> U64(48)
    return tn.mix(names + np.arange(c.cells, dtype=U64) * U64(0xC2B2AE3D27D4EB4F)), sketch


def _celled(words: int, c: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tn.kept_by("ngram_join")
        for batch in batches:
            for part, texts in tn.slices(batch):
                sets = list(shingle_sets(texts, words))
                some = [s for s in sets if len(s)]
                names, sketch = cell_keys(some, c) if some else (np.zeros((0, c.cells), U64), np.zeros((0, SKETCH), np.uint16))
                ends, at = [0], 0
                for s in sets:
                    at += c.cells if len(s) else 0
                    ends.append(at)
                rows = iter(sketch)
                sketches = [next(rows).astype("<u2").tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(k)) for k in ("doc_id", "row")), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.int64())]
                    + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tn.signed(names.ravel()))), pa.array(sketches, pa.binary())],
                    names=["doc_id", "row", "n_shingles", "node", "cells", "sketch"],
                )

    return run


def _plausible(agree: int, similarity: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose sizes and sketches are those of sets that may be similar."""
        tn.kept_by("ngram_join")
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(len(batch), SKETCH) for i in (2, 3))
            n, m = (batch.column(i).to_numpy() for i in (4, 5))
            keep = (x == y).sum(axis=1) >= agree
            keep &= similarity.denominator * np.minimum(n, m) >= similarity.numerator * np.maximum(n, m)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["low", "node"]).filter(pa.array(keep))

    return run


def _covering_regions(nodes: DataFrame, c: Cells, similarity: Fraction, rounds: int = 2) -> DataFrame:
    """(region, node) rows such that any two similar sets are in one region at least.

    In each round the pivot of every cell (its smallest node) meets the cell's other sets; those that may be similar
    become one family. A cell is done when its sets are of one family. Of the others small ones become regions of their
    own (one for each set of members) and large ones choose another pivot, from a family that the first isn't of. Large
    ones that are still not done merge the families that meet in them.
    """
    rows = nodes.select("node", F.explode("cells").alias("cell"))
    shared = rows.groupBy("cell").agg(F.min("node").alias("low"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1")
    cells = written_by_size(rows.join(shared, "cell"), "cells")
    sketches = written_by_size(cells.select("node").distinct().join(nodes.select("node", "n_shingles", "sketch"), "node"), "sketches")
    side = lambda k, v, n: sketches.select(F.col("node").alias(k), F.col("sketch").alias(v), F.col("n_shingles").alias(n))
    edges, family, own, todo = None, None, [], cells
    for _ in range(rounds):
        pairs = todo.where("node != low").select("low", "node").distinct()
        pairs = pairs.join(side("node", "y", "m"), "node").join(side("low", "x", "n"), "low").select("low", "node", "x", "y", "n", "m")
        found = written_by_size(pairs.mapInArrow(_plausible(c.agree, similarity), "low bigint, node bigint"), "plausible")
        edges = found if edges is None else edges.union(found)
        family = components(edges).select("node", F.col("component").alias("family"))
        of = todo.select("cell", "node", "n", "members").join(family, "node", "left").withColumn("family", F.coalesce("family", "node"))
        mixed = of.groupBy("cell").agg(F.min("family").alias("f0"), F.max(F.struct("family", "node")).alias("f1")).where("f0 < f1.family").select("cell", "f0", F.col("f1.node").alias("low"))
        todo = written_by_size(of.join(mixed, "cell"), "mixed")
        own.append(todo.where(F.col("n") <= LARGE_CELL).select("cell", "node", "members"))
        todo = todo.where(F.col("n") > LARGE_CELL)
        if todo.isEmpty():
            break
    member = family.select("node", "family")
    if not todo.isEmpty():
        merged = components(todo.select("f0", "family").distinct()).select(F.col("node").alias("family"), "component")
        member = member.union(todo.select("node", "family")).distinct().join(merged, "family", "left").select("node", F.coalesce("component", "family").alias("family"))
    member = member.select(F.xxhash64(F.lit("family"), "family").alias("region"), "node")
    for few in own:
        member = member.union(few.select(F.xxhash64(F.lit("cell"), "members").alias("region"), "node").distinct())
    return member


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the nodes asked for; another text under the same doc_id has another node and is left out."""
        tn.kept_by("ngram_join")
        for batch in batches:
            for part, texts in tn.slices(batch):
                sets, nodes = list(shingle_sets(texts, words)), part.column(part.schema.get_field_index("node")).to_numpy()
                own = [i for i, s in enumerate(sets) if set_hash(s) == nodes[i]]
                ends = np.cumsum([0] + [len(sets[i]) for i in own])
                values = np.concatenate([np.zeros(0, np.int64), *[tn.signed(sets[i]) for i in own]])
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(k)).take(pa.array(own, pa.int64())) for k in ("node", "regions")] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                    names=["node", "regions", "shingles"],
                )

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices over the shingles that both hold."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    out = np.zeros((len(left), len(right)), np.float32)

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows, values = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        hit = both[at] == values
        return rows[hit], at[hit]

    if not len(both):
        return out
    (lr, lc), (rr, rc) = cells(left), cells(right)
    step = 4096
    for c in range(0, len(both), step):
        x, y = (np.zeros((len(s), min(step, len(both) - c)), np.float32) for s in (left, right))
        for m, r, k in ((x, lr, lc), (y, rr, rc)):
            keep = (k >= c) & (k < c + step)
            m[r[keep], k[keep] - c] = 1
        out += x @ y.T
    return out


def similar(left: list[np.ndarray], right: list[np.ndarray], similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of (distance, linked); the link test is in whole numbers."""
    inter = intersections(left, right).astype(np.int64)
    union = np.add.outer([len(s) for s in left], [len(s) for s in right]) - inter
    linked = (similarity.denominator * inter >= similarity.numerator * union) & (union > 0)
    return 1 - inter / np.maximum(union, 1), linked


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a square matrix that connect all that it connects: at most one for each row."""
    seen, out = np.zeros(len(linked), bool), []
    for start in range(len(linked)):
        if seen[start]:
            continue
        seen[start], front = True, [start]
        while front:
            i = front.pop()
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            out += [(i, int(j)) for j in new]
            front += new.tolist()
    return out


def _links_frame(a: list, b: list) -> pd.DataFrame:
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def main_group(linked: np.ndarray) -> np.ndarray:
    """Of a matrix of sets and pivots: the sets that link to the pivots of the largest connected group."""
    masks = linked @ (1 << np.arange(linked.shape[1]))
    groups: list[int] = []
    for m in np.unique(masks[masks > 0]).tolist():
        groups = [g for g in groups if not g & m] + [m | sum(g for g in groups if g & m)]
    weight = [int((masks & g != 0).sum()) for g in groups]
    return masks & groups[int(np.argmax(weight))] != 0 if groups else np.zeros(len(linked), bool)


def region_links(sets: list[np.ndarray], similarity: Fraction) -> list[tuple[int, int]]:
    """Links of a region that connect all that is similar in it, by pivots, Voronoi cells and windows."""
    eps, out = float(1 - similarity) + 1e-9, []
    todo = np.arange(len(sets))
    while len(todo) > 4 * PIVOTS:
        d, linked = similar([sets[i] for i in todo], [sets[i] for i in todo[:PIVOTS]], similarity)
        out += [(int(todo[i]), int(todo[j])) for i, j in zip(*np.nonzero(linked), strict=True) if i != j]
        settled, opened = np.flatnonzero(main := main_group(linked)), np.flatnonzero(~main)
        opened = opened[opened >= PIVOTS]  # pivots have met all others
        near, cell = d.min(axis=1), d.argmin(axis=1)
        for c in range(PIVOTS):
            home, window = settled[cell[settled] == c], opened[d[opened, c] <= near[opened] + 2 * eps]
            if len(home) and len(window):
                _, hit = similar([sets[todo[i]] for i in window], [sets[todo[i]] for i in home], similarity)
                some = np.flatnonzero(hit.any(axis=1))
                out += [(int(todo[window[i]]), int(todo[home[j]])) for i, j in zip(some, hit[some].argmax(axis=1), strict=True)]
        todo = todo[opened]
    if len(todo) > 1:
        rest = [sets[i] for i in todo]
        out += [(int(todo[i]), int(todo[j])) for i, j in _spanning(similar(rest, rest, similarity)[1])]
    return out


def _leaf(similarity: Fraction):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """All links that a region of one task needs."""
        nodes = pdf["node"].to_numpy()
        found = region_links([np.asarray(s, np.int64) for s in pdf["shingles"]], similarity)
        return _links_frame([nodes[i] for i, _ in found], [nodes[j] for _, j in found])

    return run


def _block(similarity: Fraction):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One block of a region against another; for every set of the left, at most one link into each group that
        earlier sets of this block have connected."""
        if not len(left) or not len(right):
            return _links_frame([], [])
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        linked = similar([np.asarray(s, np.int64) for s in left["shingles"]], [np.asarray(s, np.int64) for s in right["shingles"]], similarity)[1]
        n = len(a)
        square = np.zeros((n + len(b), n + len(b)), bool)
        square[:n, n:], square[n:, :n] = linked, linked.T
        both = np.concatenate([a, b])
        found = [(i, j) for i, j in _spanning(square) if both[i] != both[j]]
        return _links_frame([both[i] for i, _ in found], [both[j] for _, j in found])

    return run


def _distances(similarity: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distances of each set to the pivots of its region, and which of them it links to."""
        tn.kept_by("ngram_join")
        for batch in (b.slice(at, WITH_PIVOTS) for b in batches for at in range(0, len(b), WITH_PIVOTS)):
            pdf = batch.to_pandas()
            d, hit = [], []
            for s, pivots in zip(pdf["shingles"], pdf["pivots"], strict=True):
                x, y = similar([np.asarray(s, np.int64)], [np.asarray(p["shingles"], np.int64) for p in pivots], similarity)
                d.append(x[0].tolist())
                hit.append(y[0].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in ("region", "node", "shingles")]
                + [pa.array([[p["node"] for p in row] for row in pdf["pivots"]], pa.list_(pa.int64())), pa.array(d, pa.list_(pa.float64())), pa.array(hit, pa.list_(pa.bool_()))],
                names=["region", "node", "shingles", "pivot_nodes", "d", "linked"],
            )

    return run


def _main_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one region's (mask, n): pivots that a set links to together are connected; marks masks of the largest group.

    There are at most 2**PIVOTS masks.
    """
    masks, n = pdf["mask"].to_numpy(), pdf["n"].to_numpy()
    groups: list[int] = []
    for m in masks.tolist():
        if m:
            groups = [g for g in groups if not g & m] + [m | sum(g for g in groups if g & m)]
    weight = [int(n[(masks & g) != 0].sum()) for g in groups]
    best = groups[int(np.argmax(weight))] if groups else 0
    return pd.DataFrame({"region": pdf["region"], "mask": masks, "main": (masks & best) != 0})


def metric_join(sets: DataFrame, similarity: Fraction, leaf: int = LEAF, depth: int = 4) -> DataFrame:
    """Links (a, b) that connect all sets of a region that similarity `similarity` connects.

    sets: node bigint, regions array<bigint>, shingles array<bigint>, one row for each node.
    """
    region = written_by_size(sets.select(F.explode("regions").alias("region"), "node", "shingles"), "region")
    out = None
    eps = float(1 - similarity) + 1e-9
    keys = [F.xxhash64("node", F.lit(i)) for i in range(PIVOTS)]
    for level in range(depth + 1):
        sizes = written_by_size(region.groupBy("region").agg(F.count("*").alias("size")), "sizes")
        small = region.join(sizes.where((F.col("size") > 1) & (F.col("size") <= leaf)).select("region"), "region", "left_semi")
        links = small.groupBy("region").applyInPandas(_leaf(similarity), "a bigint, b bigint")
        large = sizes.where(F.col("size") > leaf).select("region")
        last = large.isEmpty()
        if not last:
            rest = region.join(large, "region", "left_semi")
            if last := level == depth:
                links = links.union(_in_blocks(rest, rest, similarity, leaf, True))
            else:
                # pivots: the sets with the least of some hashes
                chosen = rest.groupBy("region").agg(*[F.min(F.struct(k.alias("h"), "node")).alias(f"p{i}") for i, k in enumerate(keys)])
                chosen = chosen.select("region", F.explode(F.array_distinct(F.array(*[f"p{i}.node" for i in range(PIVOTS)]))).alias("node"))
                pivots = rest.join(chosen, ["region", "node"]).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("node", "shingles"))).alias("pivots"))
                schema = "region bigint, node bigint, shingles array<bigint>, pivot_nodes array<bigint>, d array<double>, linked array<boolean>"
                measured = rest.join(pivots, "region").mapInArrow(_distances(similarity), schema)
                mask = F.aggregate(F.transform("linked", lambda hit, i: F.when(hit, F.pow(F.lit(2), i).cast("int")).otherwise(0)), F.lit(0), lambda x, y: x + y)
                with arrow_batches(sets.sparkSession, WITH_PIVOTS):
                    measured = written_by_size(measured.withColumn("mask", mask), "pivots")
                hit = F.explode(F.filter(F.arrays_zip("pivot_nodes", "linked"), lambda p: p["linked"]))
                links = links.union(measured.select("node", hit.alias("p")).where("node != p.pivot_nodes").select(F.col("node").alias("a"), F.col("p.pivot_nodes").alias("b")))
                groups = measured.groupBy("region", "mask").agg(F.count("*").alias("n")).groupBy("region").applyInPandas(_main_groups, "region bigint, mask int, main boolean")
                split = measured.join(groups, ["region", "mask"])
                # Voronoi cells: a settled set is in its own, an open one in every cell within its window too
                near = F.array_min("d")
                cell = lambda c: F.xxhash64("region", c, F.lit(level)).alias("region")
                settled = split.where("main").select(cell(F.array_position("d", near)), "node", "shingles")
                opened = written_by_size(split.where("not main and not array_contains(pivot_nodes, node)"), "open")  # pivots have met all others
                within = F.filter(F.transform("d", lambda x, i: F.when(x <= near + 2 * eps, (i + 1).cast("bigint"))), lambda i: i.isNotNull())
                window = opened.select("*", F.explode(within).alias("_cell")).select(cell(F.col("_cell")), "node", "shingles")
                links = links.union(_in_blocks(window, settled, similarity, leaf, False))
                region = opened.select("region", "node", "shingles")
        links = written_by_size(links, "found")
        out = links if out is None else out.union(links)
        if last:
            break
    return out


def _in_blocks(one: DataFrame, two: DataFrame, similarity: Fraction, leaf: int, same: bool) -> DataFrame:
    """Every block of `one` against every block of `two` with the same region: exact at any size. same: they are equal."""
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in ("region", "node", "shingles")])
    one, two = fresh(one), fresh(two)
    blocks = lambda df, n: df.groupBy("region").agg(F.ceil(F.count("*") / leaf).cast("int").alias(n))
    n = blocks(one, "n1").join(blocks(two, "n2"), "region")
    dealt = lambda df, k: df.join(n, "region").withColumn("block", F.pmod(F.xxhash64("node"), F.col(k)).cast("int"))
    left = dealt(one, "n1").select("region", "node", "shingles", F.col("block").alias("i"), F.explode(F.expr("sequence(block, n2 - 1)" if same else "sequence(0, n2 - 1)")).alias("j"))
    right = dealt(two, "n2").select("region", "node", "shingles", F.explode(F.expr("sequence(0, block)" if same else "sequence(0, n1 - 1)")).alias("i"), F.col("block").alias("j"))
    keys = ["region", "i", "j"]
    return fresh_keys(left).groupBy(*keys).cogroup(fresh_keys(right).groupBy(*keys)).applyInPandas(_block(similarity), "a bigint, b bigint")


def fresh_keys(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def jaccard_join(docs: DataFrame, words: int = 5, similarity: float | Fraction = Fraction(4, 5)) -> tuple[DataFrame, DataFrame]:
    """(membership, links): membership is doc_id, row (a hash of doc_id and text), n_shingles, node; links are pairs (a, b) of nodes.

    `links` connects all nodes that similar pairs connect, without listing pairs that others connect already.
    docs: doc_id bigint, text string. similarity may be a Fraction for an exact bound.
    """
    similarity = Fraction(similarity).limit_denominator(10_000)
    c = Cells.of(float(similarity))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    base = written(docs.mapInArrow(_celled(words, c), "doc_id bigint, row bigint, n_shingles bigint, node bigint, cells array<bigint>, sketch binary"), "sets")
    named = base.where("n_shingles > 0 and doc_id is not null")
    first = [F.first(k).alias(k) for k in ("n_shingles", "cells", "sketch")]
    nodes = written_by_size(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *first), "nodes")
    member = _covering_regions(nodes, c, similarity).groupBy("node").agg(F.collect_set("region").alias("regions"))
    asked = written_by_size(nodes.select("node", "doc_id").join(member, "node"), "members")
    texts = likely_in(docs, "doc_id", asked.select("doc_id")).join(asked, "doc_id")
    sets = texts.select("node", "regions", "text").mapInArrow(_sets(words), "node bigint, regions array<bigint>, shingles array<bigint>")
    return base.select("doc_id", "row", "n_shingles", "node"), metric_join(sets, similarity)


def row_components(docs: DataFrame, words: int = 5, similarity: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, row, n_shingles, component_id: the smallest doc_id that links reach (its own without any)."""
    member, links = jaccard_join(docs, words, similarity)
    roots = components(links).select("node", F.col("component").alias("root"))
    lone = F.col("n_shingles") == 0
    named = member.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = named.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    of_node = named.join(least.hint("merge"), "root").select("node", "component")
    out = member.join(of_node.hint("merge"), "node", "left")
    return out.select("doc_id", "row", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(lone, F.col("doc_id")).otherwise(F.col("component"))).alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = 5, similarity: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return row_components(docs, words, similarity).drop("row")


def keep_first_of_groups(docs: DataFrame, words: int = 5, similarity: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of docs, unchanged, whose doc_id is the smallest of their group; rows with a null doc_id stay."""
    later = row_components(docs, words, similarity).where("doc_id != component_id").select("row").distinct()
    return without_rows(docs, F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"]), later)


__all__ = ["jaccard_components", "jaccard_join", "keep_first_of_groups", "metric_join", "row_components"]
