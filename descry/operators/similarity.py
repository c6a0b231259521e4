"""Row similarity.

The number of row pairs grows with the square of the rows, so no operator here writes them
all: pairs come out above a similarity bound, and sums over all pairs come out per row.
Rows with equal descriptors are one row with a count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry import FEATURES, ID, TARGET
from descry.functions.columns import dot, norm
from descry.operators.blocks import Matrix, dense, gather_sums
from descry.session import cut_lineage, max_tasks

ROWS_PER_BLOCK = 4096
MOST_BLOCKS = 64  # blocks that all rows are cut in; larger tables have larger blocks
PARTS = 32  # partitions of the blocks
STEP = 1024  # rows of a block compared with as many of another at once
STRIP = 256  # rows whose pairs are handed on together
PIVOTS = 64
SLACK = 1e-7  # radians, over rounding in angles


def ratio_similarity(a: Column, b: Column) -> Column:
    """1 - |a-b|/(a+b); null when a+b is 0."""
    return 1 - F.try_divide(F.abs(a - b), a + b)


def overall_similarity(cosine: Column, ratio: Column) -> Column:
    return 1 - F.try_divide(F.abs(cosine - ratio), cosine + ratio)


def with_measures(pairs: DataFrame) -> DataFrame:
    """Ratio, interaction and overall similarity beside a cosine, from ``y_src``, ``y_dst``."""
    ratio = ratio_similarity(F.col("y_src"), F.col("y_dst"))
    with_ratio = pairs.withColumn("ratio", ratio)
    return with_ratio.select(
        "*", (F.col("cosine") * F.col("ratio")).alias("interaction"),
        overall_similarity(F.col("cosine"), F.col("ratio")).alias("overall"))


def anomaly_flag(overall: Column, threshold: float = 0.5) -> Column:
    """1 at or below the threshold."""
    return (overall <= threshold).cast("int")


def distinct_rows(m: Matrix, with_target: bool) -> DataFrame:
    """One row per distinct descriptor vector (and target): smallest id, number of copies."""
    keys = [FEATURES, TARGET] if with_target else [FEATURES]
    rows = m.df.filter(F.col(TARGET).isNotNull()) if with_target else m.df
    return rows.groupBy(*keys).agg(F.min(ID).alias(ID), F.count(F.lit(1)).alias("copies"))


def every_row(m: Matrix) -> DataFrame:
    """All rows, (id, features, copies), with the number of rows that have the same descriptors; a
    row repeated with its id is one row."""
    counts = m.df.groupBy(FEATURES).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    rows = m.df.filter(F.col(ID).isNotNull()).select(ID, FEATURES).distinct()
    return rows.join(counts, FEATURES, "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(length > 0, x / length, np.nan)


def _column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    column = table.column(name)
    return column.to_numpy() if isinstance(table, pa.Table) else column.to_numpy(zero_copy_only=False)


def _features(table: pa.Table, width: int) -> np.ndarray:
    flat = table.column(FEATURES).combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, width)


def cosine_pairs(m: Matrix, min_sim: float, with_target: bool = False,
                 rows_per_block: int = ROWS_PER_BLOCK, pivots: int = PIVOTS, rows: DataFrame | None = None
                 ) -> DataFrame:
    """All pairs of distinct rows whose cosine is at least ``min_sim``, exactly.

    Rows go to the cell of their nearest pivot. By the triangle inequality of angles a row
    can only have partners in cells whose pivot is within that cell's radius plus
    arccos(min_sim), so it is compared with no others. A cell of any size is cut in hashed
    blocks, and no task holds more than a few of them. Columns: src, dst, cosine, their
    numbers of copies and, on request, targets. Copies of one row are not listed as pairs;
    with ``every_row`` as ``rows`` they are, and so is each copy beside all others.
    """
    width = len(m.names)
    rows = distinct_rows(m, with_target) if rows is None else rows
    rows = cut_lineage(rows.filter(norm(F.col(FEATURES)) > 0))
    n = rows.count()
    reach = float(np.arccos(np.clip(min_sim, -1.0, 1.0))) + SLACK
    id_type = rows.schema[ID].dataType.simpleString()
    target = f", {TARGET} double" if with_target else ""
    carried = [ID, "copies", FEATURES] + ([TARGET] if with_target else [])

    k = max(1, min(pivots, -(-n // rows_per_block)))
    heads = rows.select(ID, FEATURES).orderBy(F.xxhash64(ID), ID).limit(k).collect()
    centres = _unit(np.array([r[FEATURES] for r in heads]).reshape(-1, width))

    def angles(x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(_unit(x) @ centres.T, -1.0, 1.0))

    def home(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                theta = angles(dense(batch, width))
                cell = theta.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)),
                     pa.array(theta[np.arange(len(cell)), cell])],
                    names=[*batch.schema.names, "own", "theta"])

    schema = f"{ID} {id_type}, copies long, {FEATURES} array<double>{target}"
    # The cell of a row is decided once: two pivots may tie, and a later pass over batches of
    # another size may round the other way.
    placed = cut_lineage(rows.select(*carried).mapInArrow(home, f"{schema}, own int, theta double"))
    radius, chunks = np.full(k, -np.inf), [1] * k
    size = block_size(n, rows_per_block)
    for r in placed.groupBy("own").agg(F.max("theta").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["own"]] = r["radius"]
        chunks[r["own"]] = -(-r["n"] // size)
    starts = np.concatenate([[0], np.cumsum(chunks)]).tolist()
    of_cell = lambda values: F.array(*[F.lit(v) for v in values])[F.col("own")]
    block = (of_cell(starts[:-1]) + F.pmod(F.xxhash64(ID), of_cell(chunks))).cast("int")
    cell_of = np.repeat(np.arange(k), chunks)

    def meet(a: Block, b: Block) -> Iterable[dict[str, np.ndarray]]:
        ca, cb = cell_of[a.block], cell_of[b.block]
        i = np.nonzero(angles(a.x)[:, cb] <= radius[cb] + reach)[0]
        j = np.nonzero(angles(b.x)[:, ca] <= radius[ca] + reach)[0]
        x, z = _unit(a.x[i]), _unit(b.x[j])
        for at in range(0, len(i), STRIP):
            sims = np.clip(x[at:at + STRIP] @ z.T, -1.0, 1.0)
            p, q = np.nonzero(sims >= min_sim)
            cosine, p, q = sims[p, q], i[at + p], j[q]
            one = a.ids[p] < b.ids[q]
            keep = one if a.block == b.block else a.ids[p] != b.ids[q]
            cosine, p, q, one = cosine[keep], p[keep], q[keep], one[keep]
            first = lambda u, v: np.where(one, u[p], v[q])
            last = lambda u, v: np.where(one, v[q], u[p])
            out = {"src": first(a.ids, b.ids), "dst": last(a.ids, b.ids), "cosine": cosine,
                   "n_src": first(a.more[0], b.more[0]).astype(np.int64),
                   "n_dst": last(a.more[0], b.more[0]).astype(np.int64)}
            if with_target:
                out |= {"y_src": first(a.more[1], b.more[1]), "y_dst": last(a.more[1], b.more[1])}
            order = np.lexsort((out["dst"], out["src"]))  # equal ids in runs: less to write
            yield {c: v[order] for c, v in out.items()}

    out_schema = (f"src {id_type}, dst {id_type}, cosine double, n_src long, n_dst long"
                  + (", y_src double, y_dst double" if with_target else ""))
    more = ["copies", TARGET] if with_target else ["copies"]
    blocks = packed(placed, block, starts[-1], width, more)
    return block_pairs(blocks, width, meet, out_schema, starts[-1] > 1)


def copies_of(m: Matrix, with_target: bool = False) -> DataFrame:
    """(id, rep): the row each row is a copy of, to expand pair results."""
    keys = [FEATURES, TARGET] if with_target else [FEATURES]
    reps = distinct_rows(m, with_target).withColumnRenamed(ID, "rep").drop("copies")
    return m.df.select(ID, *keys).join(reps, keys).select(ID, "rep")


class Block(NamedTuple):
    """Rows of one block by id; ``more`` are columns beside the features, as doubles."""

    block: int
    ids: np.ndarray
    x: np.ndarray
    more: list[np.ndarray]


def block_size(n: int, rows_per_block: int) -> int:
    return max(rows_per_block, -(-n // MOST_BLOCKS))


def several(n: int, rows_per_block: int) -> bool:
    """Whether hashed blocks are more than one."""
    return n > block_size(n, rows_per_block)


def packed(rows: DataFrame, block: Column, blocks: int, width: int, more: Sequence[str]) -> DataFrame:
    """(block, ids, data): one row per block, its rows side by side; each row moves once."""
    id_type = rows.schema[ID].dataType.simpleString()
    parts = max(1, min(blocks, PARTS))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        data = np.column_stack([_features(table, width), *[_column(table, c) for c in more]])
        ids, own = _column(table, ID), _column(table, "block")
        for b in np.unique(own):
            at = np.nonzero(own == b)[0]
            at = at[np.argsort(ids[at], kind="stable")]
            mine = table.column(ID).take(pa.array(at)).combine_chunks()
            mine = mine.chunk(0) if isinstance(mine, pa.ChunkedArray) else mine
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), mine),
                 pa.array([np.ascontiguousarray(data[at], np.float64).tobytes()], pa.binary())],
                names=["block", "ids", "data"])

    dealt = rows.select(ID, FEATURES, *more, block.alias("block")).repartitionById(
        parts, F.pmod(F.col("block"), F.lit(parts)))
    return cut_lineage(dealt.mapInArrow(pack, f"block int, ids array<{id_type}>, data binary"))


def hashed_blocks(rows: DataFrame, n: int, rows_per_block: int, width: int, more: Sequence[str]) -> DataFrame:
    """Blocks by hashes of the id, so they have equal sizes whatever the data."""
    b = max(1, -(-n // block_size(n, rows_per_block)))
    return packed(rows, F.pmod(F.xxhash64(ID), F.lit(b)).cast("int"), b, width, more)


def block_pairs(blocks: DataFrame, width: int, work: Callable[[Block, Block], Iterable[dict[str, np.ndarray]]],
                schema: str, several: bool = True) -> DataFrame:
    """What ``work`` makes of every two blocks, each with itself too.

    Tasks read the blocks where they are stored, as a Cartesian product does, so no row is
    shuffled once per block that it meets. Where there are not ``several``, none meets another.
    """
    side = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns])
    i, j = F.col("block_i"), F.col("block_j")
    even = (i + j) % 2 == 0  # each two blocks meet in one of two tasks, by turns
    once = (i == j) | ((i < j) & even) | ((i > j) & ~even)
    if several:
        pairs = side("i").hint("shuffle_replicate_nl").join(side("j"), once)
    else:
        pairs = blocks.select(*[F.col(c).alias(f"{c}_{s}") for s in "ij" for c in blocks.columns])

    def block(batch: pa.RecordBatch, row: int, s: str) -> Block:
        get = lambda c: batch.column(batch.schema.get_field_index(f"{c}_{s}"))[row]
        ids = get("ids").values.to_numpy(zero_copy_only=False)
        data = np.frombuffer(get("data").as_buffer(), np.float64).reshape(len(ids), -1)
        return Block(get("block").as_py(), ids, data[:, :width], list(data[:, width:].T))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                for out in work(block(batch, row, "i"), block(batch, row, "j")):
                    if len(next(iter(out.values()))):
                        yield pa.RecordBatch.from_pydict(out)

    return pairs.mapInArrow(run, schema)


def steps(a: Block, b: Block) -> Iterable[tuple[slice, slice]]:
    """Parts of two blocks that meet; of a block and itself each two parts once."""
    for s in range(0, len(a.ids), STEP):
        for t in range(s if a.block == b.block else 0, len(b.ids), STEP):
            yield slice(s, s + STEP), slice(t, t + STEP)


def measure_matrix(measure: str, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray
                   ) -> np.ndarray:
    """One of the four measures between rows i and rows j; NaN where undefined."""
    cosine = ratio = None
    if measure != "ratio":
        cosine = np.clip(_unit(x[i]) @ _unit(x[j]).T, -1.0, 1.0)
        if measure == "cosine":
            return cosine
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = y[i][:, None], y[j][None, :]
        ratio = np.where(a + b != 0, 1 - np.abs(a - b) / (a + b), np.nan)
        if measure == "ratio":
            return ratio
        if measure == "interaction":
            return cosine * ratio
        both = cosine + ratio
        return np.where(both != 0, 1 - np.abs(cosine - ratio) / both, np.nan)


def pair_sums(m: Matrix, value: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray],
                                         np.ndarray],
              rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(id, total): for each row the sum over all rows of a symmetric pair value.

    Block pairs give partial sums per row, never pairs; copies are weighed, not repeated.
    """
    width = len(m.names)
    rows = cut_lineage(distinct_rows(m, True))
    n = rows.count()
    blocks = hashed_blocks(rows, n, rows_per_block, width, [TARGET, "copies"])

    def add(a: Block, b: Block) -> Iterable[dict[str, np.ndarray]]:
        same = a.block == b.block
        left, right = np.zeros(len(a.ids)), np.zeros(len(b.ids))
        for s, t in steps(a, b):
            x, y = np.concatenate([a.x[s], b.x[t]]), np.concatenate([a.more[0][s], b.more[0][t]])
            i = np.arange(len(a.ids[s]))
            v = np.nan_to_num(value(x, y, i, np.arange(len(i), len(y))), nan=0.0)
            left[s] += v @ b.more[1][t]
            if not same or s != t:
                right[t] += v.T @ a.more[1][s]
        if same:
            yield {ID: a.ids, "part": left + right}
        else:
            yield {ID: np.concatenate([a.ids, b.ids]), "part": np.concatenate([left, right])}

    id_type = rows.schema[ID].dataType.simpleString()
    parts = block_pairs(blocks, width, add, f"{ID} {id_type}, part double", several(n, rows_per_block))
    totals = parts.groupBy(ID).agg(F.sum("part").alias("total"))
    by_rep = rows.select(ID, FEATURES, TARGET).join(totals, ID).drop(ID)
    return m.df.filter(F.col(TARGET).isNotNull()).join(by_rep, [FEATURES, TARGET]).select(ID, "total")


def anomaly_pairs(m: Matrix, threshold: float = 0.5, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(src, dst, anomaly) for every two rows with a target and a cosine: 1 where their overall
    similarity is at or below the threshold, null where it is undefined.

    This is the whole matrix, so it grows with the square of the rows; tasks hand on what one
    part of a block makes with one of another. A row repeated with its id is one row.
    """
    width = len(m.names)
    length = norm(F.col(FEATURES))
    rows = m.df.filter(F.col(ID).isNotNull() & F.col(TARGET).isNotNull() & (length > 0) & (length < float("inf")))
    rows = cut_lineage(rows.select(ID, TARGET, FEATURES).distinct())
    n = rows.count()
    blocks = hashed_blocks(rows, n, rows_per_block, width, [TARGET])

    def flags(a: Block, b: Block) -> Iterable[dict[str, np.ndarray]]:
        for s, t in steps(a, b):
            x, y = np.concatenate([a.x[s], b.x[t]]), np.concatenate([a.more[0][s], b.more[0][t]])
            ids, others = a.ids[s], b.ids[t]
            i = np.arange(len(ids))
            overall = measure_matrix("overall", x, y, i, np.arange(len(i), len(y)))
            one = ids[:, None] < others
            p, q = np.nonzero(one if a.block == b.block else ids[:, None] != others)
            overall, one = overall[p, q], one[p, q]
            yield {"src": np.where(one, ids[p], others[q]), "dst": np.where(one, others[q], ids[p]),
                   "anomaly": pa.array((overall <= threshold).astype(np.int32), mask=np.isnan(overall))}

    id_type = rows.schema[ID].dataType.simpleString()
    return block_pairs(blocks, width, flags, f"src {id_type}, dst {id_type}, anomaly int", several(n, rows_per_block))


def anomaly_degree(m: Matrix, threshold: float = 0.5, rows_per_block: int = ROWS_PER_BLOCK
                   ) -> DataFrame:
    """(id, degree): how many rows have an overall similarity at or below the threshold."""

    def flags(x, y, i, j):
        with np.errstate(invalid="ignore"):
            return (measure_matrix("overall", x, y, i, j) <= threshold).astype(float)

    return pair_sums(m, flags, rows_per_block).select(
        ID, F.col("total").cast("bigint").alias("degree"))


def closeness(m: Matrix, measure: str = "cosine", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(id, closeness): 1 / sum of (1 - similarity) over all rows; null when the sum is 0.

    For cosine the sum is linear in the row: one pass adds up all unit rows, a second takes
    a dot product. Zero rows have no cosine and no part in the sums.
    """
    if measure != "cosine":
        def gaps(x, y, i, j):
            return 1 - measure_matrix(measure, x, y, i, j)

        return pair_sums(m, gaps, rows_per_block).select(
            ID, F.try_divide(F.lit(1.0), F.col("total")).alias("closeness"))
    width = len(m.names)
    tasks = max_tasks(m.df.sparkSession)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros(width + 1)
        for batch in batches:
            if len(batch):
                x = _unit(dense(batch, width))
                live = ~np.isnan(x).any(axis=1)
                total += np.concatenate([[live.sum()], x[live].sum(axis=0)])
        yield pa.RecordBatch.from_pydict({
            "key": pa.array([0], pa.int32()), "sums": pa.array([total], pa.list_(pa.float64()))})

    parts = m.df.select(FEATURES).coalesce(tasks).mapInArrow(add, "key int, sums array<double>")
    sums = gather_sums(parts, ["key"], tasks, width + 1)[0,]
    near = F.try_divide(dot(F.col(FEATURES), sums[1:]), norm(F.col(FEATURES)))
    return m.df.select(ID, F.try_divide(F.lit(1.0), F.lit(float(sums[0])) - near).alias("closeness"))


def nearest_to(m: Matrix, anchor, k: int) -> DataFrame:
    """The ``k`` rows most similar to one row; one pass, the anchor enters as constants."""
    found = m.df.filter(F.col(ID) == F.lit(anchor)).select(FEATURES).first()
    if found is None:
        raise ValueError(f"no such row: {anchor}")
    v = np.array(found[FEATURES])
    length = float(np.sqrt(v @ v))
    if not length:
        raise ValueError("the anchor is a zero row")
    cosine = F.try_divide(dot(F.col(FEATURES), v), norm(F.col(FEATURES)) * F.lit(length))
    rows = m.df.filter(F.col(ID) != F.lit(anchor)).select(ID, cosine.alias("cosine"))
    return rows.filter(F.col("cosine").isNotNull()).orderBy(F.desc("cosine"), ID).limit(k)


def ratio_levels(df: DataFrame, min_sim: float) -> DataFrame:
    """Pairs of distinct targets whose ratio similarity is at least ``min_sim``, with the
    number of row pairs behind each; (y, y) stands for the pairs inside one target.

    The bound is a band in log(y): rows meet by band number, never all with all.
    """
    if not 0 < min_sim < 1:
        raise ValueError("min_sim must lie between 0 and 1")
    train = df.filter(F.col(TARGET).isNotNull())
    if train.filter(F.col(TARGET) <= 0).limit(1).count():
        raise ValueError("ratio similarity by bands needs positive targets")
    width = float(-np.log(min_sim / (2 - min_sim)) * (1 + 1e-9))
    levels = train.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n"))
    levels = levels.withColumn("band", F.floor(F.log(TARGET) / width))
    low = levels.select(F.col(TARGET).alias("y_low"), F.col("n").alias("n_low"),
                        F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    high = levels.select(F.col(TARGET).alias("y_high"), F.col("n").alias("n_high"), "band")
    pairs = low.join(high, "band").filter(F.col("y_low") <= F.col("y_high"))
    ratio = ratio_similarity(F.col("y_low"), F.col("y_high"))
    count = F.when(F.col("y_low") == F.col("y_high"),
                   (F.col("n_low") * (F.col("n_low") - 1) / 2).cast("bigint")
                   ).otherwise(F.col("n_low") * F.col("n_high"))
    return pairs.select("y_low", "y_high", ratio.alias("ratio"), count.alias("n_pairs")).filter(
        (F.col("ratio") >= min_sim) & (F.col("n_pairs") > 0))
