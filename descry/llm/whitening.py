"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the centred covariance V = Xc' Xc / n come from a block of
vectors Q (d x k, k a little above the components wanted) that only ever meets the data
through distributed products V Q: every task adds Xc' (Xc Q) over its rows, and the partials
are added up by the cluster. The centring is done in the task (x - S/n), so V is never formed.

One round filters the block by a Chebyshev polynomial of V of degree ``degree`` on the
interval [0, a], with a the smallest Ritz value of the block: the three-term recurrence
Y(j+1) = 2 (V - c) Y(j) / e - Y(j-1) damps every eigenvalue below a and lifts those above it.
QR orthonormalises the filtered block, one more product gives V Q, and Rayleigh-Ritz on
Q' V Q gives Ritz values and vectors. Rounds go on until every wanted Ritz pair has a
residual norm ||V v - theta v|| at most ``tolerance`` times the largest Ritz value: the
certificate. A round costs ``degree`` passes over the rows; the driver holds only d x k.

Contract values: x = floor(1024 c) + 100000 per entry; rows whose vector is null or holds a
null, NaN or infinite entry take no part. ``deviation`` is sum over dimensions of
(n x - S)^2 in exact decimal arithmetic, ``whitened`` the centred x projected on the
component over sqrt(eigenvalue), ``explained`` eigenvalue over trace(V) (the trace from the
exact deviations), ``identity_error`` the largest absolute entry of the whitened
coordinates' covariance minus the identity, from one more pass over the rows.

Edge cases: an empty table (or one without a valid row) gives no rows; vectors of
differing lengths are refused by a ValueError; components whose eigenvalue is not above
1e-12 of the trace (constant data, fewer rows than components) are left out, so a row may
have fewer than eight; repeated rows count as often as they occur; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm.common import exactly, stored
from descry.operators.blocks import gather_sums

KEY, VECTOR = "vec_id", "embedding"
#: Fixed values of the contract: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100000
COMPONENTS = 8
DEGREE = 8
TOLERANCE = 1e-12
ROUNDS = 200
SEED = 7


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id and x (array<long>) of the rows whose vectors are whole and finite."""
    vec = F.col(VECTOR)
    whole = vec.isNotNull() & F.forall(
        vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    x = F.transform(vec, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))
    return exactly(embeddings, KEY, VECTOR).where(whole).select(KEY, x.alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def product(vectors: DataFrame, mean: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """V @ block, V the centred covariance with divisor n, by one pass over the rows."""
    d, k = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((d, k))
        for batch in batches:
            if batch.num_rows:
                xc = _matrix(batch, d) - mean
                acc += xc.T @ (xc @ block)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), pa.array([acc.ravel()], pa.list_(pa.float64()))], names=["key", "sums"])

    partials = vectors.select("x").mapInArrow(run, "key int, sums array<double>")
    sums = gather_sums(partials, ["key"], vectors.rdd.getNumPartitions(), d * k)
    return sums[(0,)].reshape(d, k) / n


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz on span(q): Ritz values falling, vectors, and V times them."""
    h = q.T @ vq
    theta, w = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-theta, kind="stable")
    theta, w = theta[order], w[:, order]
    return theta, q @ w, vq @ w


def chebyshev(vectors: DataFrame, mean: np.ndarray, n: int, v: np.ndarray, vv: np.ndarray,
              lower: float, upper: float, degree: int) -> np.ndarray:
    """p(V) v for the Chebyshev polynomial of ``degree`` on [lower, upper], scaled as it goes."""
    c, e = (upper + lower) / 2, (upper - lower) / 2
    before, now = v, (vv - c * v) / e
    for _ in range(degree - 1):
        after = 2 * (product(vectors, mean, now, n) - c * now) / e - before
        scale = np.abs(after).max() or 1.0
        before, now = now / scale, after / scale
    return now


def eigenpairs(vectors: DataFrame, mean: np.ndarray, n: int, d: int, wanted: int,
               degree: int = DEGREE, tolerance: float = TOLERANCE, rounds: int = ROUNDS
               ) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The ``wanted`` leading eigenpairs, the largest residual over the largest value, and
    the number of passes."""
    k = min(d, max(4 * wanted, wanted + 8))
    q, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, k)))
    vq, passes = product(vectors, mean, q, n), 1
    for _ in range(rounds):
        theta, v, vv = ritz(q, vq)
        top = max(theta[0], 0.0)
        residual = np.linalg.norm(vv[:, :wanted] - v[:, :wanted] * theta[:wanted], axis=0).max()
        if top == 0.0 or residual <= tolerance * top or k == d:
            return theta[:wanted], v[:, :wanted], residual / top if top else 0.0, passes
        edge = max(theta[-1], 0.0)
        if edge <= 1e-3 * top:  # the block reaches the null space: plain products lift the rest
            y = vv
        else:
            y = chebyshev(vectors, mean, n, v, vv, 0.0, edge, degree)
            passes += degree - 1
        q, _ = np.linalg.qr(y)
        vq, passes = product(vectors, mean, q, n), passes + 1
    theta, v, vv = ritz(q, vq)
    residual = np.linalg.norm(vv[:, :wanted] - v[:, :wanted] * theta[:wanted], axis=0).max()
    return theta[:wanted], v[:, :wanted], residual / max(theta[0], 1e-300), passes


def whiten(embeddings: DataFrame, components: int = COMPONENTS, degree: int = DEGREE,
           tolerance: float = TOLERANCE) -> DataFrame:
    """Per whole row and component: vec_id, component, n, deviation, whitened, explained,
    identity_error, eigenvalue, residual (the certificate) and passes."""
    spark = embeddings.sparkSession
    vectors = stored(prepared(embeddings), "whiten-x")
    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("lo"),
                        F.max(F.size("x")).alias("hi")).first()
    n, d = shape["n"], shape["hi"] or 0
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double, eigenvalue double, residual double, passes int")
    if n == 0 or d == 0:
        return spark.createDataFrame([], schema)
    if shape["lo"] != d:
        raise ValueError(f"vectors of {shape['lo']} and {d} entries")
    sums = (vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"))
            .orderBy("i").collect())
    s = [int(r["s"]) for r in sums]
    mean = np.array([v / n for v in s])
    total = F.lit(np.array(s, dtype=np.int64).tolist()).cast("array<decimal(38,0)>")
    dev = F.aggregate(F.zip_with("x", total, lambda x, t: F.lit(n).cast("decimal(38,0)") * x - t),
                      F.lit(0).cast("decimal(38,0)"), lambda acc, v: acc + v * v)
    with_dev = vectors.withColumn("dev", dev)
    trace_sum = with_dev.agg(F.sum("dev").alias("t")).first()["t"]
    trace = float(trace_sum) / float(n) ** 3 if trace_sum is not None else 0.0
    theta, v, residual, passes = eigenpairs(vectors, mean, n, d, min(components, d), degree, tolerance)
    keep = theta > 1e-12 * max(trace, 0.0)
    theta, v = theta[keep], v[:, keep]
    if len(theta) == 0:
        return spark.createDataFrame([], schema)
    basis = v / np.sqrt(theta)
    covariance = basis.T @ product(vectors, mean, basis, n)
    identity_error = float(np.abs(covariance - np.eye(len(theta))).max())
    m = len(theta)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w = (_matrix(batch, d) - mean) @ basis
            rows = batch.num_rows
            each = pa.array(np.repeat(np.arange(rows), m))
            yield pa.RecordBatch.from_arrays([
                batch.column(KEY).take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)),
                batch.column("dev").take(each), pa.array(w.ravel())],
                names=[KEY, "component", "deviation", "whitened"])

    rows = with_dev.select(KEY, "x", F.col("dev").cast("long").alias("dev")).mapInArrow(
        project, "vec_id long, component int, deviation long, whitened double")
    value = F.element_at(F.array(*[F.lit(float(t)) for t in theta]), F.col("component"))
    return rows.select(
        KEY, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        (value / F.lit(trace)).alias("explained"), F.lit(identity_error).alias("identity_error"),
        value.alias("eigenvalue"), F.lit(float(residual)).alias("residual"), F.lit(passes).alias("passes"))
