"""Connected components of a table of links by alternating large-star and small-star rounds.

Links stay in Spark tables throughout; a node of any degree is handled by an aggregation and a join, never by one group.
Tables of at most LINKS_PER_TASK links, which are counted first, are settled by one task instead of many small shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written, written_by_size

LINKS_PER_TASK = 500_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links of one task: labels and their labels are lowered until nothing changes."""
    found = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not found:
        return
    nodes, flat = np.unique(np.concatenate(found, axis=1), return_inverse=True)
    a, b = flat.reshape(2, -1)
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (label[a], label[b], a, b):
            np.minimum.at(label, end, low)
        label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def _minimum(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = _minimum(links)
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `links` (two bigint columns), component being its smallest reachable node.

    Rows with a null end or two equal ends are ignored; repeated links count once; no links give an empty table.
    Raises RuntimeError if `rounds` rounds don't suffice (their number grows with the logarithm of the longest path).
    """
    a, b = (F.col(c) for c in links.columns)
    links = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    state = _state(links)
    if state[0] <= LINKS_PER_TASK:
        return written(links.coalesce(1).mapInArrow(_settle, "node bigint, component bigint"), "components")
    for _ in range(rounds):
        links = written_by_size(_small_star(_large_star(links)), "links")
        after = _state(links)
        if after == state:
            nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.union(links.select("v", "v").distinct())
        state = after
    raise RuntimeError(f"no fixed point after {rounds} rounds")
