"""Embedding near-dedup by E8 lattice hashing.

Each table projects a unit vector at random onto two blocks of 8 dimensions and decodes both to their nearest E8 lattice
point; the two points (with label and dimension) are its home cell. A vector also probes cells whose points are
the neighbours of its own that lie nearest. Whoever meets in a cell is verified by cosine in double precision.

Groups of near copies aren't expanded into all pairs. Vectors within half the threshold's angle of a leader link with
each other by the triangle inequality on the sphere, so they form a *class* with a radius; cells then bring classes
together, once each. Two classes link as a whole, or not at all, if their leaders' angle and radii say so; only
classes in between are compared member by member, large ones in blocks.

Vectors that are null, zero, or hold null or non-finite components, and those without a label, link with nothing and are
returned with 0 links. Vectors of different dimensions never link. Equal rows are one vector, returned once for each row; rows that
share an id but not the vector are vectors of their own, whatever their order; rows with a null id link as others do and
name no component. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import written

U64 = np.uint64


@dataclass(frozen=True)
class Lattice:
    """Tables, neighbours probed in each of two blocks, scale of unit vectors before decoding, and seed."""

    tables: int = 8
    probes: int = 3
    scale: float = 1.5
    seed: int = 8


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if math.prod(s) > 0]
    return np.array(out)


MINIMAL = minimal_vectors()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    point = np.rint(x)
    error = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(error[odd]).argmax(axis=1)
    point[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 + 1/2."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def _hash_points(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return ((2 * points).astype(np.int64).astype(U64) * salt).sum(axis=-1, dtype=U64)


def cells(unit: np.ndarray, label: np.ndarray, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (n, tables) and probed cells (n, tables * (probes + 1)**2), the home cell among them."""
    n, dim = unit.shape
    home, probed = [], []
    for t in range(lattice.tables):
        rng = np.random.default_rng([lattice.seed, t, dim])
        mixed = []
        for block in range(2):
            x = unit @ (rng.standard_normal((dim, 8)) / math.sqrt(8) * lattice.scale) + rng.random(8)
            salt = rng.integers(1, 2**63, 8, dtype=U64) * U64(2) + U64(1)
            point = nearest_e8(x)
            near = np.argsort(-((x - point) @ MINIMAL.T), axis=1, kind="stable")[:, : lattice.probes]
            base = _hash_points(point, salt)
            mixed.append(np.concatenate([base[:, None], base[:, None] + _hash_points(MINIMAL, salt)[near]], axis=1))
        own = (label.astype(np.int64).astype(U64) * U64(1_000_003) + U64(dim * 1009 + t)) * U64(0x9E3779B97F4A7C15)
        both = mixed[0][:, :, None] * U64(0xC2B2AE3D27D4EB4F) + mixed[1][:, None, :] + own[:, None, None]
        both = (both ^ (both >> U64(29))) * U64(0xBF58476D1CE4E5B9)
        both = (both ^ (both >> U64(32))).reshape(n, -1)
        home.append(both[:, 0])
        probed.append(both)
    return np.stack(home, axis=1), np.concatenate(probed, axis=1)


def _rows(column: pa.Array, at: np.ndarray, width: int) -> np.ndarray:
    """The lists at these places, all of this length, as a matrix of doubles; nulls become NaN."""
    return column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), width)


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(np.ascontiguousarray(matrix).ravel()))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for width in np.unique(lengths[lengths > 0]).tolist():
        yield width, np.flatnonzero(lengths == width)


def _hashed(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Usable vectors at unit length, with their cells."""
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                for width, rows in _by_length(part.column("embedding")):
                    x = _rows(part.column("embedding"), rows, width)
                    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                    x, rows = x[good], rows[good]
                    if not len(rows):
                        continue
                    x = x / np.abs(x).max(axis=1)[:, None]
                    unit = x / np.linalg.norm(x, axis=1)[:, None]
                    home, probed = cells(unit, part.column("label").to_numpy()[rows], lattice)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("vec_id").take(pa.array(rows)), _lists(unit), _lists(home.view(np.int64)), _lists(probed.view(np.int64))],
                        names=["vec_id", "unit", "home", "probed"],
                    )

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends cos, the inner product of columns x and y; vectors of different dimensions have none above -2."""
    for batch in batches:
        keep = [c for c in batch.schema.names if c not in ("x", "y")]
        x, y = batch.column("x"), batch.column("y")
        cos = np.full(len(batch), -2.0)
        other = y.value_lengths().to_numpy(zero_copy_only=False)
        for width, rows in _by_length(x):
            rows = rows[other[rows] == width]
            cos[rows] = np.einsum("ij,ij->i", _rows(x, rows, width), _rows(y, rows, width))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(cos)], names=[*keep, "cos"])


def with_cosine(pairs: DataFrame) -> DataFrame:
    kept = ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c not in ("x", "y"))
    return pairs.mapInArrow(_cosines, f"{kept}, cos double")


def _block(least: float):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Links of two blocks: how many each member has, and one partner of it."""
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "partner": np.zeros(0, np.int64)})
        hit = np.stack(left["unit"].to_list()) @ np.stack(right["unit"].to_list()).T >= least
        a, b = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        out = pd.DataFrame({"vec_id": np.concatenate([a, b]), "n": np.concatenate([hit.sum(1), hit.sum(0)]), "partner": np.concatenate([b[hit.argmax(1)], a[hit.argmax(0)]])})
        return out[out["n"] > 0]

    return run


def _classes(base: DataFrame, angle: float, rounds: int) -> DataFrame:
    """base with leader, away (the angle to the leader, at most angle / 2) and, at leaders, size; leaders lead themselves.

    In a round a lone vector joins the leader of its home cell, which is the one with the largest class; as a vector has one
    home cell in each table, that leader stays.
    """
    known = base.withColumns({"leader": F.col("vec_id"), "away": F.lit(0.0), "size": F.lit(1).cast("bigint")})
    least = math.cos(angle / 2) + 1e-12
    for t in range(rounds):
        lead = known.where("vec_id = leader").select("vec_id", "unit", "size", F.col("home")[t].alias("cell"))
        best = lead.groupBy("cell").agg(F.min(F.struct(-F.col("size"), F.col("vec_id"), F.col("unit"))).alias("b"), F.count("*").alias("meet")).where("meet > 1")
        pairs = lead.where("size = 1").join(best, "cell").where("vec_id != b.vec_id").select("vec_id", F.col("b.vec_id").alias("to"), F.col("unit").alias("x"), F.col("b.unit").alias("y"))
        moved = with_cosine(pairs).where(F.col("cos") >= least).select("vec_id", "to", F.acos(F.least("cos", F.lit(1.0))).alias("angle"))
        moved = written(moved, "moved")
        grown = moved.groupBy(F.col("to").alias("vec_id")).agg(F.count("*").alias("more"))
        known = known.join(moved, "vec_id", "left").join(grown, "vec_id", "left")
        size = F.when(F.col("to").isNull(), F.col("size") + F.coalesce("more", F.lit(0)))
        known = known.select("vec_id", "unit", "home", "probed", F.coalesce("to", "leader").alias("leader"), F.coalesce("angle", "away").alias("away"), size.alias("size"))
        known = written(known, "classes")
    return known


def lattice_links(vectors: DataFrame, threshold: float = 0.93, lattice: Lattice = Lattice(), pairwise: int = 4096, block: int = 512, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(counts, links): counts is (vec_id, n_links) of vectors that link; links (a, b) connect what is linked.

    vectors: vec_id bigint (unique, or equal rows), embedding array of numbers, label int. `pairwise` bounds the member pairs that two classes
    may have to be compared as rows; beyond it they are compared in blocks of `block` members.
    """
    angle = math.acos(threshold)
    usable = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.col("label").cast("bigint").alias("label"))
    usable = usable.where("vec_id is not null and label is not null and embedding is not null").dropDuplicates(["vec_id"])
    schema = "vec_id bigint, unit array<double>, home array<bigint>, probed array<bigint>"
    base = written(usable.mapInArrow(_hashed(lattice), schema), "cells")
    member = _classes(base, angle, min(rounds, lattice.tables))

    homes = member.select(F.explode("home").alias("cell"), F.col("leader").alias("a")).distinct()
    visits = member.select(F.explode("probed").alias("cell"), F.col("leader").alias("b")).distinct()
    met = homes.join(visits, "cell").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    radius = member.groupBy("leader").agg(F.max("away").alias("radius"))
    leads = written(member.where("vec_id = leader").select("leader", "unit", "size").join(radius, "leader"), "leaders")
    side = lambda k, v: leads.select(F.col("leader").alias(k), F.col("unit").alias(v), F.col("size").alias(f"size_{k}"), F.col("radius").alias(f"radius_{k}"))
    pairs = with_cosine(met.join(side("a", "x"), "a").join(side("b", "y"), "b"))
    spread = F.col("radius_a") + F.col("radius_b")
    lone = (F.col("size_a") == 1) & (F.col("size_b") == 1)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least("cos", F.lit(1.0))))
    verdict = (
        F.when(lone, F.when(F.col("cos") >= threshold, "all").otherwise("none"))
        .when(apart + spread <= angle - 1e-9, "all")
        .when(apart - spread > angle + 1e-9, "none")
        .otherwise("some")
    )
    pairs = written(pairs.select("a", "b", "size_a", "size_b", verdict.alias("verdict")).where("verdict != 'none'"), "met")

    whole = pairs.where("verdict = 'all'")
    by_class = whole.select(F.col("a").alias("leader"), F.col("size_b").alias("n")).union(whole.select("b", "size_a"))
    by_class = by_class.union(leads.where("size > 1").select("leader", F.col("size") - 1)).groupBy("leader").agg(F.sum("n").alias("n"))
    counts = member.select("vec_id", "leader").join(by_class, "leader").select("vec_id", "n")
    links = whole.select("a", "b").union(member.where("leader != vec_id").select("leader", "vec_id"))

    some = pairs.where("verdict = 'some'")
    product = F.col("size_a") * F.col("size_b")
    units = member.select("vec_id", "leader", "unit")
    few = some.where(product <= pairwise).select("a", "b")
    if not few.isEmpty():
        left = units.select(F.col("vec_id").alias("p"), F.col("leader").alias("a"), F.col("unit").alias("x"))
        right = units.select(F.col("vec_id").alias("q"), F.col("leader").alias("b"), F.col("unit").alias("y"))
        few = few.join(left, "a").join(right, "b")
        few = written(with_cosine(few.select("p", "q", "x", "y")).where(F.col("cos") >= threshold).select("p", "q"), "few")
        links = links.union(few)
        counts = counts.union(few.select("p", F.lit(1).cast("bigint"))).union(few.select("q", F.lit(1).cast("bigint")))

    many = some.where(product > pairwise)
    if not many.isEmpty():
        many = many.select("a", "b", F.explode(F.sequence(F.lit(0), F.floor((F.col("size_a") - 1) / block))).alias("i"), "size_b")
        many = many.select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.floor((F.col("size_b") - 1) / block))).alias("j"))
        dealt = units.join(leads.select("leader", "size"), "leader").select("vec_id", "leader", "unit", F.pmod(F.xxhash64("vec_id"), F.floor((F.col("size") - 1) / block) + 1).alias("part"))
        keys = ["a", "b", "i", "j"]
        one = many.join(dealt.select("vec_id", "unit", F.col("leader").alias("a"), F.col("part").alias("i")), ["a", "i"]).select(*keys, "vec_id", "unit")
        two = many.join(dealt.select("vec_id", "unit", F.col("leader").alias("b"), F.col("part").alias("j")), ["b", "j"]).select(*[F.col(c).alias(c) for c in (*keys, "vec_id", "unit")])
        found = one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInPandas(_block(threshold), "vec_id bigint, n bigint, partner bigint")
        found = written(found, "blocks")
        links = links.union(found.select("vec_id", "partner"))
        counts = counts.union(found.select("vec_id", "n"))
    return counts.groupBy("vec_id").agg(F.sum("n").alias("n_links")), links


def node_key(vectors: DataFrame) -> Column:
    """A number for each different row: rows that share an id are told apart by their vectors and labels."""
    return F.xxhash64(vectors["vec_id"].cast("bigint"), vectors["embedding"], vectors["label"].cast("bigint"))


def embedding_digest(vectors: DataFrame, threshold: float = 0.93, lattice: Lattice = Lattice()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. Equal rows are one vector; rows that share an id but not the vector
    are vectors of their own; a row without an id links as any other and names no component."""
    node = node_key(vectors)
    counts, links = lattice_links(vectors.select(node.alias("vec_id"), "embedding", "label"), threshold, lattice)
    counts = counts.withColumnRenamed("vec_id", "node")
    comp = components(links).select("node", F.col("component").alias("root"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), node.alias("node"))
    rows = rows.join(counts, "node", "left").join(comp, "node", "left")
    least = rows.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    rows = rows.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
