"""Exact top-k search over binary codes by incremental multi-index hashing.

A code has the signs of all components, cut into segments of 16 bits, and a row is indexed under the value of each
of its S segments. In round r every open query probes, in each segment, the values at Hamming distance r from its own; rows
met are verified on the whole code. A code farther than r from the query in every segment is at distance
S * (r + 1) or more, so a query closes once its k-th verified distance is below that. A row is taken only from the first of
the segments in which it is nearest, so it is met once.

The index is dealt by segment, the upper bits of its value, and, where more than BLOCK codes share those, by a hash
into blocks; a query goes to the buckets whose upper bits are near enough, so nothing is broadcast but the
buckets' sizes (at most 64 a segment). In a task a block's entries are held as arrays and queries stream by.

Equal codes are one index entry with their k + 1 smallest ids (no others can be among the k nearest of any query), so
exact copies cost nothing. Ties are broken by id. A row is not its own neighbour. Null vectors, or vectors with null
components, have no code: they are neither found nor answered; missing components of shorter vectors, and NaN, count as not
positive. Fewer than k other rows: all are returned. Rows with a null id are dropped; repeated ids count once, with their
least code; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

WIDTH = 16
#: Upper bits of a segment's value that name a bucket.
PREFIX = 6
#: Codes that a task holds at a time.
BLOCK = 50_000
#: Queries that are compared with a block at a time.
AT_ONCE = 64


def _signs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum([0] + vectors.value_lengths().to_pylist())
            bits = np.zeros((len(batch), size), bool)
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                bits[i, : b - a] = flat[a:b] > 0
            codes = np.packbits(bits, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "code"])

    return run


def sign_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code: the signs of the components as bytes, as many segments as the widest vector needs."""
    usable = vectors.where("vec_id is not null and embedding is not null").where(~F.exists("embedding", lambda x: x.isNull()))
    widest = usable.agg(F.max(F.size("embedding"))).first()[0] or 1
    usable = usable.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    codes = usable.mapInArrow(_signs(-(-widest // WIDTH) * WIDTH), "vec_id bigint, code binary")
    return codes.groupBy("vec_id").agg(F.min("code").alias("code"))


class Block:
    """The entries of a block: ordered by their values in one segment, with the places of each value that occurs."""

    def __init__(self, parts: list[pa.RecordBatch], segment: int):
        codes = self.bytes_of(parts)
        values = codes.view("<u2")
        order = np.argsort(values[:, segment], kind="stable")
        self.segment, self.values, self.words = segment, values[order], self.words_of(codes[order])
        self.own, self.starts, self.counts = np.unique(self.values[:, segment], return_index=True, return_counts=True)
        lists = pa.concat_arrays([p.column("ids") for p in parts]).take(pa.array(order))
        self.ids, self.ends = lists.flatten().to_numpy(), np.cumsum([0] + lists.value_lengths().to_pylist())
        self.least = self.ids[self.ends[:-1]]

    @staticmethod
    def bytes_of(parts: list[pa.RecordBatch]) -> np.ndarray:
        rows = [c for p in parts for c in p.column("code").to_pylist()]
        return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)

    @staticmethod
    def words_of(codes: np.ndarray) -> np.ndarray:
        return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)

    def search(self, batch: pa.RecordBatch, radius: int, k: int) -> Iterator[pa.RecordBatch]:
        codes = self.bytes_of([batch])
        values, words = codes.view("<u2"), self.words_of(codes)
        query, bound = (batch.column(c).to_numpy() for c in ("query_id", "bound"))
        for at in range(0, len(batch), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            q, v = np.nonzero(np.bitwise_count(values[part, self.segment][:, None] ^ self.own[None]) == radius)
            n = self.counts[v]
            entry = np.repeat(self.starts[v] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            q = np.repeat(q, n) + at
            distance = np.bitwise_count(self.words[entry] ^ words[q]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(distance <= bound[q])
            q, entry, distance = q[near], entry[near], distance[near]
            apart = np.bitwise_count(self.values[entry] ^ values[q])
            first = (apart[:, : self.segment] > radius).all(axis=1) & (apart[:, self.segment :] >= radius).all(axis=1)
            q, entry, distance = q[first], entry[first], distance[first]
            # k + 1 entries hold the k nearest ids, as only the query's own entry may be without another
            top = self._top(q, distance, self.least[entry], k + 1)
            q, entry, distance = q[top], entry[top], distance[top]
            n = self.ends[entry + 1] - self.ends[entry]
            found = self.ids[np.repeat(self.ends[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            q, distance = np.repeat(q, n), np.repeat(distance, n)
            other = np.flatnonzero(found != query[q])
            q, distance, found = q[other], distance[other], found[other]
            top = self._top(q, distance, found, k)
            yield pa.RecordBatch.from_arrays([pa.array(query[q[top]]), pa.array(found[top]), pa.array(distance[top].astype(np.int32))], names=["query_id", "vec_id", "distance"])

    @staticmethod
    def _top(q: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Places of the k least (distance, id) of each query."""
        order = np.lexsort((ids, distance, q))
        start = np.flatnonzero(np.diff(q[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
        return order[rank < k]


def _probe(radius: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket and block, entries (without a query_id) before queries."""
        now, parts, block = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            place = np.stack([batch.column(c).to_numpy() for c in ("segment", "prefix", "block", "kind")])
            cuts = [0, *(np.flatnonzero((np.diff(place) != 0).any(axis=0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                bucket = tuple(place[:3, a].tolist())
                if bucket != now:
                    now, parts, block = bucket, [], None
                if not place[3, a]:
                    parts.append(batch.slice(a, b - a))
                elif parts:
                    block = block or Block(parts, bucket[0])
                    yield from block.search(batch.slice(a, b - a), radius, k)

    return run


def _segments(code: str, n: int) -> Column:
    """The prefixes of a code's segments."""
    high = lambda i: F.expr(f"conv(hex(substring({code}, {2 * i + 2}, 1)), 16, 10)").cast("int")
    return F.posexplode(F.array(*[F.shiftright(high(i), 8 - PREFIX) for i in range(n)])).alias("segment", "prefix")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, distance: the k rows nearest to each query, both given as (vec_id, code), codes of one length."""
    same = Window.partitionBy("code").orderBy("vec_id")
    index = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index = written(index, "codes")
    size, n_bytes = index.agg(F.sum(F.size("ids")), F.max(F.octet_length("code"))).first()
    n, k_or_all = (n_bytes or 2) // 2, min(k, size or 0)
    placed = index.select("code", "ids", _segments("code", n))
    buckets = F.broadcast(written(placed.groupBy("segment", "prefix").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "buckets"))
    dealt = placed.join(buckets, ["segment", "prefix"])
    place = ["segment", "prefix", "block", "kind"]
    entries = dealt.select("segment", "prefix", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "code", "ids", F.lit(0).cast("bigint").alias("query_id"), F.lit(0).alias("bound"))
    found_type = "array<struct<distance: int, vec_id: bigint>>"
    state = queries.select(F.col("vec_id").alias("query_id"), "code", F.lit(n * WIDTH + 1).alias("bound"), F.array().cast(found_type).alias("found"), F.lit(False).alias("closed"))
    done = []
    for radius in range(WIDTH + 1):
        near = F.expr(f"filter(sequence(0, {(1 << PREFIX) - 1}), m -> bit_count(m) between {radius - WIDTH + PREFIX} and {radius})")
        visits = state.where("not closed").select("query_id", "code", "bound", _segments("code", n)).withColumn("mask", F.explode(near))
        visits = visits.withColumn("prefix", F.col("prefix").bitwiseXOR(F.col("mask"))).join(buckets, ["segment", "prefix"])
        visits = visits.select("segment", "prefix", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(1).alias("kind"), "code", F.array().cast("array<bigint>").alias("ids"), "query_id", "bound")
        met = entries.union(visits).repartition("segment", "prefix", "block").sortWithinPartitions(*place)
        met = met.mapInArrow(_probe(radius, k), "query_id bigint, vec_id bigint, distance int")
        before = state.where("not closed").select("query_id", F.explode("found").alias("f")).select("query_id", "f.vec_id", "f.distance")
        best = _nearest(met.union(before), k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))).alias("best"))
        after = state.where("not closed").select("query_id", "code", "bound").join(best, "query_id", "left").withColumn("found", F.coalesce("best", F.array().cast(found_type)))
        kth = F.try_element_at("found", F.lit(-1))["distance"]
        closed = F.lit(radius == WIDTH) | (F.size("found") >= k_or_all) & F.coalesce(kth < n * (radius + 1), F.lit(k_or_all == 0))
        state = written(after.select("query_id", "code", F.when(F.size("found") >= k, kth).otherwise(F.col("bound")).alias("bound"), "found", closed.alias("closed")), "state")
        done.append(state.where("closed"))
        if state.where("not closed").isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    out = out.select("query_id", F.posexplode("found").alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", "f.distance")


def search_digest(vectors: DataFrame, k: int = 10, every: int = 20) -> DataFrame:
    """Queries are the rows whose id is divisible by `every`, searched against all rows."""
    codes = written(sign_codes(vectors), "signs")
    return top_k(codes.where(F.col("vec_id") % every == 0), codes, k)


SEARCH_SQL = """WITH rows AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    pairs AS (SELECT q.vec_id AS query_id, r.vec_id,
                     list_sum(list_transform(range(1, greatest(len(q.embedding), len(r.embedding)) + 1),
                                             lambda i: CASE WHEN coalesce(q.embedding[i] > 0, false) <> coalesce(r.embedding[i] > 0, false) THEN 1 ELSE 0 END))::INTEGER AS distance
              FROM rows q JOIN rows r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INTEGER AS rank, vec_id, distance FROM pairs
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10"""
