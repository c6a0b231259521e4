"""Exact top-k by inner product over buckets of vectors of similar length.

Vectors are sorted by length and cut into blocks whose shortest is not much shorter than the
longest. A query's k-th best score in the block of the longest vectors is a bound ``theta``
that no answer may fall below. In a block of greatest length ``l`` a candidate needs the
cosine ``theta / (|q| * l)``: above one, the block is skipped; if it is high, candidates
outside the region that it leaves for the query's largest coordinates are dropped; if it is
low, only those too short for the bound are. What is left is verified by its products.

Queries and candidates meet in blocks, each pair of blocks once, and a pair hands on at most k
candidates a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.llm.common import exactly, stored

K = 5
BLOCK, QUERIES = 4096, 512  # vectors of a candidate block and of a query block
SPREAD = 0.9  # shortest to longest vector of a block
HIGH = 0.6  # local cosine from which coordinates prune better than lengths
FOCUS = 4  # coordinates that are looked at
LANES = 64  # groups of candidate blocks that query blocks are dealt to
PACKED = ("dim int, block long, longest double, ids array<bigint>, rows array<bigint>, "
          "lengths array<double>, payload binary")


def quantised(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", scale: int = 256
              ) -> DataFrame:
    """(row, id, v array<bigint>, len): floor(scale * x) of every valid vector.

    Null ids, null vectors, and vectors with a null or non-finite component take no part.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = exactly(vectors, key, value).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"),
        F.col(value).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    whole = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return whole.withColumn("len", norm)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one dimension, longest first.

    Rows are dealt by ranges of length and number, so vectors of one length, even copies of
    one vector, are split like others."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("dim"), F.col("len").desc(), F.col("row")]
    dealt = rows.withColumn("dim", F.size("v")).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            ids, numbers, lengths, vectors, dims = zip(*held)
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                     pa.list_(pa.float64()), pa.binary())
            values = (dims[0], numbers[0], lengths[0], ids, numbers, lengths,
                      np.array(vectors, "<i8").tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                names=["dim", "block", "longest", "ids", "rows", "lengths", "payload"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) >= size or r["dim"] != held[0][4]
                             or r["len"] < SPREAD * held[0][2]):
                    yield block()
                    held = []
                held.append((r["id"], r["row"], r["len"], r["v"], r["dim"]))
        if held:
            yield block()

    return stored(dealt.select("id", "row", "len", "v", "dim").mapInArrow(cut, PACKED), "blocks")


def _matrix(payload: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(payload, "<i8").reshape(n, dim)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; in floating point where that is exact."""
    if q.size and c.size and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0 ** 53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id, then the smaller row."""
    if len(scores) > 8 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((rows[at], ids[at], -scores[at]))][:k]


def surviving(q: np.ndarray, length: float, theta: float, c: np.ndarray, lengths: np.ndarray
              ) -> np.ndarray:
    """Places of the candidates of a block that the bound does not exclude; by cosine above
    ``HIGH`` the feasible regions of the query's largest coordinates, else by length."""
    if theta <= 0 or not length or not lengths[0]:
        return np.arange(len(lengths))
    need = theta / (length * lengths[0]) * (1 - 1e-9)
    if need > 1:
        return np.empty(0, np.int64)
    long_enough = int(np.searchsorted(-lengths, -(theta / length * (1 - 1e-9)), "right"))
    if need < HIGH:
        return np.arange(long_enough)
    keep = np.ones(long_enough, bool)
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        unit = q[f] / length
        slack = np.sqrt(max((1 - need * need) * (1 - unit * unit), 0.0)) + 1e-9
        own = c[:long_enough, f] / lengths[:long_enough]
        keep &= (own >= unit * need - slack) | (unit < 0)
        keep &= (own <= unit * need + slack) | (unit > 0)
    return np.flatnonzero(keep)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield {n: batch.column(n)[i] for n in batch.schema.names}


def _numbers(cell) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False)


def bounds(k: int):
    """Query blocks with each query's k-th best score in one candidate block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _pairs(batches):
            dim, rows, crows = p["dim"].as_py(), _numbers(p["rows"]), _numbers(p["c_rows"])
            q = _matrix(p["payload"].as_py(), dim, len(rows))
            c = _matrix(p["c_payload"].as_py(), dim, len(crows))
            scores = products(q, c).astype(np.float64)
            scores[rows[:, None] == crows[None, :]] = -np.inf
            theta = np.full(len(rows), -np.inf)
            if len(crows) >= k:
                theta = np.partition(scores, len(crows) - k, axis=1)[:, len(crows) - k]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([p[n].as_py()], t) for n, t in (
                    ("dim", pa.int32()), ("block", pa.int64()), ("longest", pa.float64()),
                    ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())),
                    ("lengths", pa.list_(pa.float64())), ("payload", pa.binary()))],
                 pa.array([theta.tolist()], pa.list_(pa.float64())),
                 pa.array([float(theta.min())], pa.float64()), pa.array([p["c_lanes"].as_py()], pa.int32())],
                names=["dim", "block", "longest", "ids", "rows", "lengths", "payload", "theta", "least", "c_lanes"])

    return run


def searched(k: int):
    """At most k candidates of a block for each query of another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _pairs(batches):
            dim = p["dim"].as_py()
            ids, rows, lengths, theta = (_numbers(p[n]) for n in ("ids", "rows", "lengths", "theta"))
            cids, crows, clengths = (_numbers(p["c_" + n]) for n in ("ids", "rows", "lengths"))
            q = _matrix(p["payload"].as_py(), dim, len(rows))
            c = _matrix(p["c_payload"].as_py(), dim, len(crows))
            out: list[tuple] = []
            loose = [i for i in range(len(rows)) if lengths[i] * clengths[0] * HIGH > theta[i]]
            whole = dict(zip(loose, products(q[loose], c), strict=True)) if loose else {}
            for i in range(len(rows)):
                at = surviving(q[i], lengths[i], theta[i], c, clengths)
                at = at[crows[at] != rows[i]]
                if not len(at):
                    continue
                scores = whole[i][at] if i in whole else products(q[i:i + 1], c[at])[0]
                for j in best(scores, cids[at], crows[at], k):
                    out.append((rows[i], ids[i], cids[at[j]], crows[at[j]], scores[j]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 5)],
                names=["query_row", "query_id", "vec_id", "row", "score"])

    return run


def _lane(block: str, lanes: str) -> Column:
    return F.pmod(F.xxhash64(block), F.col(lanes)).cast("int")


def _lanes(lanes: str) -> Column:
    return F.sequence(F.lit(0), F.col(lanes) - 1)


def in_lanes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks of one dimension and lane together, by shuffle: none passes through the driver."""
    return a.hint("merge").join(b.hint("merge"), ["dim", "lane"])


def top_k(vectors: DataFrame, queries: Column, k: int = K, block: int = BLOCK,
          query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for every row that ``queries``
    (an expression over ``id``) selects.

    Ties go to the smaller vec_id. Only vectors of the query's own dimension are its
    candidates. A repeated id is a row of its own: copies of a query answer it, and are asked
    themselves. Fewer than k others give fewer rows; an empty table gives an empty table.
    """
    rows = stored(quantised(vectors), "vectors")
    c = packed(rows, block)
    q = packed(rows.filter(queries), query_block)
    other = c.select("dim", *[F.col(n).alias(f"c_{n}") for n in
                              ("block", "longest", "ids", "rows", "lengths", "payload")])
    # Rows of these tables hold whole blocks, and their files say little of their size in memory. So only the
    # table of dimensions is broadcast; lanes, no more than there are blocks to deal, bring blocks together.
    seed = c.groupBy("dim").agg(F.max_by("block", F.struct("longest", -F.col("block"))).alias("c_block"),
                                F.least(F.count(F.lit(1)), F.lit(LANES)).cast("int").alias("c_lanes"))
    dims = F.broadcast(stored(seed.join(F.broadcast(q.groupBy("dim").agg(
        F.least(F.count(F.lit(1)), F.lit(LANES)).cast("int").alias("lanes"))), "dim"), "dims"))
    first = in_lanes(q.join(dims.drop("c_block"), "dim").withColumn("lane", _lane("block", "lanes")).drop("lanes"),
                     other.join(dims.drop("c_lanes"), ["dim", "c_block"]).withColumn("lane", F.explode(_lanes("lanes")))
                     .drop("lanes"))
    asked = stored(first.mapInArrow(bounds(k), f"{PACKED}, theta array<double>, least double, c_lanes int"), "asked")
    # A stated set of queries against all rows, in blocks: lanes deal the block pairs to tasks.
    met = in_lanes(asked.withColumn("lane", F.explode(_lanes("c_lanes"))).drop("c_lanes"),
                   other.join(dims.select("dim", "c_lanes"), "dim").withColumn("lane", _lane("c_block", "c_lanes"))
                   .drop("c_lanes")).filter(F.col("longest") * F.col("c_longest") * (1 + 1e-9) >= F.col("least"))
    found = met.drop("lane").mapInArrow(
        searched(k), "query_row long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


#: All queries against all rows, for DuckDB.
TOP_K_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, c.r,
             list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS rank FROM s)
WHERE rank <= 5
"""
