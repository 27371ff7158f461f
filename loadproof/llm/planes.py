"""Centroid clustering over bit planes: exact integer k-means by weighted AND-popcounts.

Vectors of 64 integers are kept as planes: plane j packs bit j of all 64 components into one unsigned 64-bit word, in
two's complement, so that its weight is 2 ** j, or -2 ** j for the last. The dot product of two vectors is the sum over
pairs of planes of the product of their weights times the number of bits that both have, which is exact; squared
distances follow from it. As many planes are kept as the largest component needs.

Vectors are packed once and never shuffled. A round sends the centroids to all tasks, each of which
returns one row for each cluster and component; their sums and the counts are what the driver sees, whatever the input.

Defined results: vectors that are null, don't have 64 components or hold null or non-finite ones take no part; with fewer than
K of them there are as many centroids; none give no rows; repeated rows are vectors of their own, and of several with
one id the least by components comes first among the starting centroids; null ids are kept and come last there; ties go to the smaller
cluster; components are held at plus or minus 2 ** 27 after scaling and inertias at the largest long, since larger distances are no longs;
extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadproof.llm.common import stored, table

K, ROUNDS, SCALE, WIDTH, SEED = 8, 10, 1024, 64, 3
#: Scaled components are held within this, so that squared distances are longs.
HELD = 1 << 27


def scaled(vector: str, scale: int, held: int) -> Column:
    """floor(scale * x) of all components as longs; null where the vector is null or a component is null or not finite."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    one = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(held))), F.lit(float(-held)))).cast("long")
    return F.when(finite, F.transform(x, one))


def pack(x: np.ndarray, n_planes: int) -> np.ndarray:
    """The planes (rows, n_planes) of integers (rows, 64)."""
    bits = (x[:, None, :] >> np.arange(n_planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def unpack_sums(planes: np.ndarray) -> np.ndarray:
    """Componentwise sums of the vectors."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return weights(planes.shape[1]) @ bits.sum(axis=0, dtype=np.int64)


def weights(n_planes: int) -> np.ndarray:
    w = np.int64(1) << np.arange(n_planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def distances(planes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, centroids)."""
    w = weights(planes.shape[1])
    dots = np.zeros((len(planes), len(centroids)), np.int64)
    norms, own = np.zeros(len(planes), np.int64), np.zeros(len(centroids), np.int64)
    for i, wi in enumerate(w):
        for j, wj in enumerate(w):
            dots += wi * wj * np.bitwise_count(planes[:, i, None] & centroids[None, :, j])
            own += wi * wj * np.bitwise_count(centroids[:, i] & centroids[:, j])
        for j in range(i + 1):
            norms += (1 + (j < i)) * wi * w[j] * np.bitwise_count(planes[:, i] & planes[:, j])
    return norms[:, None] + own[None, :] - 2 * dots


def _read(column: pa.Array, n_planes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, n_planes)


def _round(packed: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums by (cluster, component), and counts by (cluster, -1), of the vectors nearest to each centroid."""
    n_planes = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), WIDTH + 1), np.int64)
        for batch in batches:
            planes = _read(batch.column(0), n_planes)
            nearest = distances(planes, centroids).argmin(axis=1)
            for c in np.unique(nearest):
                own = planes[nearest == c]
                sums[c, 0] += len(own)
                sums[c, 1:] += unpack_sums(own)
        cluster, dim = np.divmod(np.arange(sums.size, dtype=np.int32), WIDTH + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(dim - 1), pa.array(sums.ravel())], names=["cluster", "dim", "s"])

    rows = packed.select("planes").mapInArrow(run, "cluster int, dim int, s long").groupBy("cluster", "dim").agg(F.sum("s").alias("s")).collect()
    return {(r[0], r[1]): r[2] for r in rows}


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of 64 finite components."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled(vector_col, scale, HELD).alias("x")).where(F.size("x") == WIDTH)
    low, high = kept.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = [r[0] for r in kept.select("x", name.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).select("x").collect()]
    if not start:
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    n_planes = max(int(low).bit_length(), int(high).bit_length()) + 1

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = pack(batch.column(1).flatten().to_numpy().reshape(-1, WIDTH), n_planes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in planes], pa.binary())], names=["id", "planes"])

    packed = stored(kept.mapInArrow(packing, "id long, planes binary"))
    values = [list(map(int, x)) for x in start]
    for _ in range(rounds):
        sums = _round(packed, pack(np.array(values, np.int64), n_planes))
        values = [[sums[c, d] // sums[c, -1] for d in range(WIDTH)] if sums.get((c, -1)) else v for c, v in enumerate(values)]
    final = pack(np.array(values, np.int64), n_planes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = distances(_read(batch.column(1), n_planes), final)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(away.argmin(axis=1), pa.int32()), pa.array(away.min(axis=1))], names=["id", "cluster", "distance"])

    placed = stored(packed.mapInArrow(assign, "id long, cluster int, distance long"))
    of = {r[0]: int(r[1]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}
    held = lambda n: F.lit(min(n, 2**63 - 1)).cast("long")
    at = F.col("cluster")
    return placed.select(
        F.col("id").alias(id_col), "cluster", "distance", F.array(*[held(of.get(c, 0)) for c in range(len(values))])[at].alias("cluster_inertia"), held(sum(of.values())).alias("inertia"),
        F.array(*[F.lit(hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for v in values])[at].alias("centroid_sha256"),
    )


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) x FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"l AS MATERIALIZED (SELECT r, unnest(generate_series(1, {WIDTH})) d, unnest(x) v FROM v)",
        f"s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, x) - 1 c, x FROM v QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, x) <= {K})",
        f"c0 AS MATERIALIZED (SELECT c, unnest(generate_series(1, {WIDTH})) d, unnest(x) v FROM s)",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"d{i} AS (SELECT r, c, CAST(sum((l.v - k.v) * (l.v - k.v)) AS BIGINT) distance FROM l JOIN c{i} k USING (d) GROUP BY r, c)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, c, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)")
        if i < ROUNDS:
            mean = f"SELECT c, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) v FROM (SELECT c, d, sum(v) s, count(*) n FROM a{i} JOIN l USING (r) GROUP BY c, d)"
            parts.append(f"c{i + 1} AS MATERIALIZED ({mean} UNION ALL SELECT * FROM c{i} WHERE c NOT IN (SELECT c FROM a{i}))")
    digest = f"h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) centroid_sha256 FROM c{ROUNDS} GROUP BY c)"
    result = f"SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) inertia, centroid_sha256 FROM a{ROUNDS} JOIN v USING (r) JOIN h USING (c)"
    return f"WITH {', '.join([*parts, digest])} {result}"


OP12_SQL = _sql()
