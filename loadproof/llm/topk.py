"""Exact top-k inner product search by dual-tree traversal of cover trees.

1. Centres are fitted on a bounded sample of the candidates (at most SAMPLE vectors, CELLS centres of a length, lengths as
   the sample has them). Every vector goes to the cell of its nearest centre, and every cell's radius is measured over all its
   vectors. A cell of many vectors is split into shards of bounded size.
2. Each query is searched in one shard of its own cell. Its k-th best score there is a bound for all that follows.
3. A query goes on to the shards of those cells alone whose ball can hold as much: <q, c> + |q| R. Nothing else is copied,
   candidates never are. A task holds one shard and streams its queries, in blocks of neighbours.

A shard and a block both become cover trees: a node has a centre, the radius that covers its points, and
children whose centres lie apart by half the radius. A pair of nodes is pruned when
<q, r> + |q| R_r + |r| R_q + R_q R_r, the most any of its points can score, is below the worst k-th score in
the query node. The shards' k best meet in a rank over each query.

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
only vectors of the same length are compared; empty tables give no rows; a query is a distinct (id, vector), its own id is
no candidate; each row is a candidate, so repeated rows appear repeatedly; ties go to the smaller
id; scores beyond a long are held at its bounds; null ids are left out; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadproof.llm.common import small_batches, stored, table

K, EVERY, SCALE = 5, 50, 256
#: Numbers in one shard of candidates, queries in a block, points in a leaf, children of a node.
SHARD, BLOCK, LEAF, FAN = 1 << 22, 1024, 128, 16
#: Cells whose sizes may be sent to all.
SENT_CELLS = 100_000
#: Vectors that centres are fitted on; the most centres of a length, and the numbers that a cell should hold at least.
SAMPLE, CELLS, CELL = 8192, 256, 1 << 17


class Node:
    __slots__ = ("centre", "children", "norm", "radius", "rows")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: np.ndarray):
        away = np.sqrt(np.maximum(((points[rows] - centre) ** 2).sum(1), 0))
        self.centre, self.norm, self.rows, self.children = centre, float(np.sqrt(centre @ centre)), rows, []
        self.radius = float(away.max()) * (1 + 1e-12)
        if len(rows) <= LEAF or self.radius == 0:
            return
        left, owner, centres, near = np.arange(len(rows)), np.full(len(rows), -1), [], np.full(len(rows), np.inf)
        while len(left) and len(centres) < FAN:  # a net: centres more than half the radius apart
            c = points[rows[left[np.argmax(near[left])] if centres else left[np.argmin(away[left])]]]
            d = np.sqrt(np.maximum(((points[rows] - c) ** 2).sum(1), 0))
            owner = np.where(d < near, len(centres), owner)
            near = np.minimum(near, d)
            centres.append(c)
            left = np.flatnonzero(near > self.radius / 2)
        if len(centres) > 1:
            self.children = [Node(points, rows[owner == i], c) for i, c in enumerate(centres) if (owner == i).any()]


def _products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = np.abs(q).max(initial=0) * np.abs(r).max(initial=0) * q.shape[1]
    if most < 2**53:
        return (q @ r.T).astype(np.int64)
    whole = np.array([[int(x) for x in v] for v in q], object) @ np.array([[int(x) for x in v] for v in r], object).T
    return np.array([[min(max(x, -(2**63)), 2**63 - 1) for x in v] for v in whole], np.int64)


def search(q_ids: np.ndarray, q: np.ndarray, r_ids: np.ndarray, r: np.ndarray, k: int = K, least: np.ndarray | None = None, tree: Node | None = None) -> list[list[tuple[int, int]]]:
    """For each query its k best (score, id), by score downward, then id; lower scores than a query's least may be missing."""
    best: list[list[tuple[int, int]]] = [[] for _ in q]  # heaps of (score, -id)
    worst = np.full(len(q), -np.inf) if least is None else least.copy()
    start = (Node(q, np.arange(len(q)), q.mean(0)), tree or Node(r, np.arange(len(r)), r.mean(0)))

    def bounds(some: list[Node], others: list[Node]) -> np.ndarray:
        """The most that points of each pair of nodes can score, with room for rounding."""
        inner = np.stack([a.centre for a in some]) @ np.stack([b.centre for b in others]).T
        a, b = (np.array([(n.radius, n.norm) for n in nodes]).T for nodes in (some, others))
        top = inner + np.outer(a[0], b[1]) + np.outer(a[1], b[0]) + np.outer(a[0], b[0])
        return top + 1e-9 * (np.abs(top) + np.outer(a[1], b[1])) + 1e-6

    def compare(a: Node, b: Node) -> None:
        scores, ids = _products(q[a.rows], r[b.rows]), r_ids[b.rows]
        for at in np.flatnonzero((scores >= worst[a.rows][:, None]).any(1)):
            i = a.rows[at]
            others = ids != q_ids[i]
            row, own = scores[at][others], ids[others]
            heap, least = best[i], worst[i]
            if len(row) > k:
                least = max(least, np.partition(row, -k)[-k])
            for j in np.flatnonzero(row >= least):
                one = (int(row[j]), -int(own[j]))
                if len(heap) < k:
                    heapq.heappush(heap, one)
                elif one > heap[0]:
                    heapq.heapreplace(heap, one)
            if len(heap) == k:
                worst[i] = heap[0][0]

    stack = [(float(bounds([start[0]], [start[1]])[0, 0]), *start)]
    while stack:
        top, a, b = stack.pop()
        if top < worst[a.rows].min():
            continue
        if not a.children and not b.children:
            compare(a, b)
            continue
        some, others = a.children or [a], b.children or [b]
        tops = bounds(some, others)
        order = np.argsort(tops, axis=None, kind="stable")  # the most promising pair is tried first
        stack += [(float(tops.flat[o]), some[o // len(others)], others[o % len(others)]) for o in order]
    return [[(s, -i) for s, i in sorted(h, reverse=True)] for h in best]


_TYPES = {ord("h"): "<i2", ord("i"): "<i4", ord("d"): "<f8"}


def pack(v: np.ndarray) -> bytes:
    """A vector of whole numbers in the smallest of three types, named by its first byte."""
    most = np.abs(v).max()
    kind = b"h" if most < 1 << 15 else b"i" if most < 1 << 31 else b"d"
    return kind + v.astype(_TYPES[kind[0]]).tobytes()


def unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(x, _TYPES[x[0]], offset=1).astype(float)


def centres_of(sample: list[np.ndarray], n: int) -> dict[int, np.ndarray]:
    """Centres for each length in the sample, for n vectors in all, by a few rounds of means."""
    out, rng = {}, np.random.Generator(np.random.PCG64(5))
    for dim in sorted({len(v) for v in sample}):
        points = np.array([v for v in sample if len(v) == dim])
        wanted = min(CELLS, len(points), max(1, n * len(points) // len(sample) * dim // CELL))
        centres = points[rng.permutation(len(points))[:wanted]]
        for _ in range(6):
            own = _nearest(points, centres)[0]
            counts = np.bincount(own, minlength=wanted)
            centres = np.array([points[own == i].mean(0) if counts[i] else centres[i] for i in range(wanted)])
        out[dim] = centres
    return out


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point and the distance to it, measured by differences."""
    own = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
    return own, np.sqrt(((points - centres[own]) ** 2).sum(1))


_PLACED = "id long, dim int, cell int, away double, mark long, x binary"


def _place(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(id, dim, cell, away, mark, x) of (id, v): cell 0 around the origin for lengths without centres; mark tells vectors of one id."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = batch.column(1).flatten().to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
            rows = np.split(flat, np.cumsum(n)[:-1]) if len(n) else []
            cell, away = np.zeros(len(n), np.int32), np.zeros(len(n))
            for dim in np.unique(n):
                at = np.flatnonzero(n == dim)
                cell[at], away[at] = _nearest(np.array([rows[i] for i in at]), held.value.get(int(dim), np.zeros((1, dim))))
            packed = [pack(v) for v in rows]
            mark = [int.from_bytes(hashlib.blake2b(x, digest_size=7).digest(), "little") for x in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(cell), pa.array(away), pa.array(mark, pa.int64()), pa.array(packed, pa.binary())], names=["id", "dim", "cell", "away", "mark", "x"])

    return vectors.mapInArrow(run, _PLACED)


def _shard_searches(candidates: DataFrame, queries: DataFrame, parts: int, k: int) -> DataFrame:
    """(query_id, mark, vec_id, score) of candidates and queries in shards (dim, cell, shard, ord, id, mark, x, least)."""
    key = ["dim", "cell", "shard"]
    rows = candidates.select(*key, F.lit(0).alias("side"), "ord", "id", "mark", "x", "least").unionByName(queries.select(*key, F.lit(1).alias("side"), "ord", "id", "mark", "x", "least"))
    rows = rows.repartition(parts, *key).sortWithinPartitions(*key, "side", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, points, block, tree = None, [], [], [], None

        def found() -> pa.RecordBatch:
            out = []
            for (i, mark, _, _), best in zip(block, search(np.array([b[0] for b in block]), np.array([b[2] for b in block]), ids, points, k, np.array([b[3] for b in block]), tree), strict=True):
                out += [(i, mark, c, s) for s, c in best]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["query_id", "mark", "vec_id", "score"])

        for batch in batches:
            for dim, cell, shard, side, _, i, mark, x, least in zip(*(batch.column(c).to_pylist() for c in range(9)), strict=True):
                if (dim, cell, shard) != at:
                    if block:
                        yield found()
                    at, ids, points, block, tree = (dim, cell, shard), [], [], [], None
                if side == 0:
                    ids.append(i)
                    points.append(unpack(x))
                elif len(ids):
                    if tree is None:
                        ids, points = np.array(ids), np.array(points)
                        tree = Node(points, np.arange(len(points)), points.mean(0))
                    block.append((i, mark, unpack(x), least))
                    if len(block) == BLOCK:
                        yield found()
                        block = []
        if block:
            yield found()

    return rows.mapInArrow(run, "query_id long, mark long, vec_id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score) over vectors of whole numbers held as doubles."""
    spark = candidates.sparkSession
    small_batches(spark)
    id_, vector = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`").cast("array<double>")

    def take(df: DataFrame) -> DataFrame:
        good = F.col("v").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return df.select(id_.cast("long").alias("id"), vector.alias("v")).where(good)

    c, q = take(candidates), take(queries)
    n = c.count()
    sample = [np.array(r["v"]) for r in c.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    centres = centres_of(sample, n) if sample else {}
    placed = stored(_place(c, centres))
    asked = stored(_place(q, centres).dropDuplicates(["id", "dim", "mark"]))
    sizes = stored(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") * F.col("dim") / SHARD).cast("int").alias("shards"), F.max("away").alias("radius")))
    total = sizes.agg(F.coalesce(F.sum("shards"), F.lit(0)), F.count("*")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total[0])
    # a row for each cell: at most CELLS for each length of the sample, and one for each rarer length
    cells = F.broadcast(sizes) if total[1] <= SENT_CELLS else sizes
    shard_of = lambda: F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard")
    key, rest = ["dim", "cell"], ["id", "mark", "x"]
    dealt = placed.join(cells, key).select(*key, shard_of(), F.col("away").alias("ord"), *rest, F.lit(None).cast("double").alias("least"))
    nothing = F.lit(float("-inf"))
    own = asked.join(cells, key).select(*key, shard_of(), F.col("away").alias("ord"), *rest, nothing.alias("least"))
    first = stored(_shard_searches(dealt, own, parts, k))
    bound = first.groupBy(F.col("query_id").alias("id"), "mark").agg(F.count("*").alias("n"), F.min("score").alias("score")).select("id", "mark", F.when(F.col("n") >= k, F.col("score")).cast("double").alias("least"))
    known = {(r["dim"], r["cell"]): r["radius"] for r in sizes.where(F.col("dim").isin(sorted(centres))).collect()}  # at most CELLS for each length of the sample
    balls = spark.sparkContext.broadcast({d: (x, np.array([known.get((d, i), -1.0) for i in range(len(x))])) for d, x in centres.items()})

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the cells whose ball can hold as much as its least score; all cells of a length without centres."""
        for batch in batches:
            out = []
            for i, dim, mark, x, least in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if dim in balls.value:
                    (centre, radius), v = balls.value[dim], unpack(x)
                    length = np.sqrt(v @ v) * (1 + 1e-12)
                    inner = centre @ v
                    top = inner + length * radius * (1 + 1e-12)
                    top += 1e-9 * (np.abs(top) + length * np.sqrt((centre**2).sum(1))) + 1e-6
                    out.append(np.flatnonzero((radius >= 0) & ~(top < least)).tolist())
                else:
                    out.append([0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(out, pa.list_(pa.int32()))], names=["id", "dim", "mark", "x", "least", "cells"])

    bounded = asked.join(bound, ["id", "mark"], "left").withColumn("least", F.coalesce("least", nothing))
    reached = bounded.select("id", "dim", "mark", "x", "least").mapInArrow(reach, "id long, dim int, mark long, x binary, least double, cells array<int>")
    home = asked.select("id", "dim", "mark", F.col("cell").alias("own"))
    pairs = reached.join(home, ["id", "dim", "mark"]).select(*rest, "dim", "least", "own", F.explode("cells").alias("cell")).join(cells, key)
    every = pairs.select(*key, "own", *rest, "least", "shards", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    every = every.where((F.col("own") != F.col("cell")) | (F.col("shard") != F.pmod(F.xxhash64("id"), F.col("shards"))))
    onward = every.select(*key, "shard", F.col("own").cast("double").alias("ord"), *rest, "least")
    found = first.unionByName(_shard_searches(dealt, onward, parts, k))
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(vector: str) -> Column:
    """floor(256 * x) of each component, as doubles; components that are null or not finite stay so."""

    def one(x: Column) -> Column:
        d = x.cast("double") * SCALE
        return F.when(F.abs(d) < 2.0**53, F.floor(d).cast("double")).otherwise(d)  # beyond that every double is whole

    return F.transform(vector, one)


def op6_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", scaled("embedding").alias("vector"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP6_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) score
FROM (SELECT DISTINCT * FROM v WHERE vec_id % {EVERY} = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
