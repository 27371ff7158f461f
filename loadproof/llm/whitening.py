"""Embedding whitening: leading components of the covariance by Chebyshev-filtered subspace iteration.

Vectors become integers floor(256 * c). The fit list is each distinct vector once; its count, sums and sums of squares are exact.
The covariance is never formed: a pass multiplies it with a block Q, each task adding up (X - mean)' ((X - mean) Q) over
its own rows, of which d * m sums come back. A block of m random columns is filtered by a Chebyshev polynomial of degree
DEGREE, one pass a degree, that is small on the interval from 0 to the least Ritz value, where the
unwanted spectrum lies, and grows fast above it; QR makes the block orthonormal again and Rayleigh-Ritz turns it to the eigenvectors' estimates. That goes on
until the residuals |V u - e u| of the wanted components certify them to double precision.

Defined results: vectors that are null, empty or hold null or non-finite components give no rows; each length of vectors
has a fit of its own (lengths are few); components without variance (their share of the largest is below 1e-12) are left out, so one distinct
vector alone gives no rows, as does an empty table; repeated rows count once in the fit and come out each; null ids are kept; entries are held at
plus or minus 2 ** 31 after scaling and deviations at the largest long; equal eigenvalues may share any basis; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadproof.llm.common import stored, table
from loadproof.llm.planes import scaled

K, SCALE, HELD = 4, 256, 1 << 31
#: Columns of the block for each wanted component, degree of the filter, the most rounds.
COLUMNS, DEGREE, ROUNDS = 8, 10, 300
#: Residuals, as a share of the largest eigenvalue, that are certain enough; and that are if they fall no more.
SURE, ENOUGH = 2e-14, 1e-11
#: Eigenvalues below this share of the largest are none.
NONE = 1e-12


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _sums(fit: DataFrame, d: int, size: int, of) -> np.ndarray:
    """The sum of of(x) over the fit list's rows x; of gives `size` doubles for a matrix of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(_matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    parts = fit.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(size)
    out[parts.column(0).to_numpy()] = parts.column(1).to_numpy()
    return out


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], list[int]]:
    """Count, sums and sums of squares of the fit list, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, [0] * d, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            if len(x) and int(np.abs(x).max()) ** 2 * len(x) >= 2**62:
                x = x.astype(object)
            s = [a + int(b) for a, b in zip(s, x.sum(axis=0), strict=True)]
            q = [a + int(b) for a, b in zip(q, (x * x).sum(axis=0), strict=True)]
        exact = lambda values: pa.array(list(map(Decimal, values)), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), exact([n, *s]), exact([0, *q])], names=["i", "s", "q"])

    rows = {r[0]: (int(r[1]), int(r[2])) for r in fit.mapInArrow(run, "i int, s decimal(38,0), q decimal(38,0)").groupBy("i").agg(F.sum("s"), F.sum("q")).collect()}
    return rows[-1][0], [rows[i][0] for i in range(d)], [rows[i][1] for i in range(d)]


def leading(product, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors of a positive semi-definite matrix, of which only product(block) is known."""
    m = min(d, COLUMNS * k)
    block = np.linalg.qr(np.random.default_rng(13).standard_normal((d, m)))[0]
    image, last = product(block), np.inf
    for _ in range(ROUNDS):
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        top = values[0]
        wanted = max(1, int((values[:k] > NONE * top).sum()))
        off = np.linalg.norm(image[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0).max()
        if top <= 0 or off <= SURE * top or (off <= ENOUGH * top and off > last / 2):
            return values[:k], block[:, :k]
        last = off
        # the filter: 0 to `edge` is damped, its growth scaled to 1 at the largest eigenvalue
        edge = max(values[-1], 1e-6 * top)
        half = centre = edge / 2
        sigma = first = half / (top - centre)
        before, now = block, (image - centre * block) * (sigma / half)
        for _ in range(DEGREE - 1):
            following = 1 / (2 / first - sigma)
            before, now = now, (product(now) - centre * now) * (2 * following / half) - before * (sigma * following)
            sigma = following
        block = np.linalg.qr(now)[0]
        image = product(block)
    raise ArithmeticError(f"no convergence in {ROUNDS} rounds: residual {last:.3g} of {top:.3g}")


def _whitened(kept: DataFrame, d: int, k: int) -> DataFrame:
    fit = stored(kept.select("x").distinct())
    n, s, q = moments(fit, d)
    mean = np.array([float(Fraction(a, n)) for a in s])
    trace = float(sum(Fraction(n * b - a * a, n * n) for a, b in zip(s, q, strict=True)))

    def product(block: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return (centred.T @ (centred @ block)).ravel()

        return _sums(fit, d, block.size, of).reshape(block.shape) / n

    schema = "id long, component int, deviation long, whitened double"
    values, vectors = leading(product, d, k) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    real = values > NONE * max(values, default=0)
    values, vectors = values[real], vectors[:, real]
    c = len(values)
    project = vectors / np.sqrt(values)

    def covariance(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ project
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    total = _sums(fit, d, c + c * c, covariance) / n
    identity = np.abs(total[c:].reshape(c, c) - np.outer(total[:c], total[:c]) - np.eye(c)).max(initial=0.0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            big = len(x) and d * (2 * n * max(int(np.abs(x).max()), max(map(abs, s)) // n + 1)) ** 2 >= 2**62
            away = (x.astype(object) if big else x) * n - np.array(s, object if big else np.int64)
            deviation = np.minimum((away * away).sum(axis=1), 2**63 - 1).astype(np.int64)
            for i in range(c):
                white = (x - mean) @ project[:, i]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), i + 1, np.int32)), pa.array(deviation), pa.array(white)], names=["id", "component", "deviation", "whitened"])

    share = F.array(*[F.lit(float(e / trace)) for e in values])[F.col("component") - 1] if c else F.lit(None).cast("double")
    return kept.mapInArrow(rows, schema).select("id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(identity)).alias("identity_error"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each vector and leading component."""
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled(vector_col, scale, HELD).alias("x")).where(F.size("x") > 0)
    lengths = sorted(r[0] for r in kept.select(F.size("x").alias("d")).distinct().collect())
    parts = [_whitened(kept.where(F.size("x") == d), d, k) for d in lengths]
    empty = vectors.sparkSession.createDataFrame([], "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return (reduce(DataFrame.union, parts) if parts else empty).withColumnRenamed("id", id_col)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
