"""Second moments of all column pairs in one pass: correlation, F tests, product screen.

Each task adds up column-block products of its rows; only these sums are shuffled, in two
rounds, so their number per group is bounded whatever the number of input partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry import FEATURES, TARGET
from descry.functions.columns import quoted
from descry.functions.stats import f_tail
from descry.operators.blocks import (BLOCK, FAN_IN, STATE, Matrix, add_up, dense, matrix,
                                     sums_batch, values_of)
from descry.operators.profile import column_stats
from descry.session import max_tasks

def _block_pairs(width: int) -> tuple[list[slice], list[tuple[int, int]]]:
    blocks = [slice(s, min(s + BLOCK, width)) for s in range(0, width, BLOCK)]
    pairs = [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]
    return blocks, pairs


def _pair_sums(m: Matrix, stats: Callable[[np.ndarray, np.ndarray, np.ndarray | None], list],
               n_stats: int, center: np.ndarray, scale: np.ndarray, with_target: bool,
               fan_in: int = FAN_IN) -> DataFrame:
    """(bi, bj, sums): ``stats`` of every column-block pair, bi <= bj, over all rows.

    When the sums of all pairs would not fit a task, the pairs are spread over several
    passes of the input.
    """
    width = len(m.names)
    blocks, pairs = _block_pairs(width)
    side = min(BLOCK, width)
    per_pass = max(1, STATE // (n_stats * side * side * 8))
    tasks = max_tasks(m.df.sparkSession)
    cols = [FEATURES] + ([TARGET] if with_target else [])
    rows = m.df.select(*cols).coalesce(tasks)

    def one_pass(chunk: list[tuple[int, int]]):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                if not len(batch):
                    continue
                x = (dense(batch, width) - center) / scale
                y = values_of(batch, TARGET) if with_target else None
                for i, j in chunk:
                    part = np.stack(stats(x[:, blocks[i]], x[:, blocks[j]], y))
                    total[i, j] = total[i, j] + part if (i, j) in total else part
            if total:
                yield sums_batch({"bi": [k[0] for k in total], "bj": [k[1] for k in total]},
                                 list(total.values()))
        return run

    out = None
    for start in range(0, len(pairs), per_pass):
        part = rows.mapInArrow(one_pass(pairs[start : start + per_pass]),
                               "bi int, bj int, sums array<double>")
        out = part if out is None else out.unionByName(part)
    return add_up(out, ["bi", "bj"], tasks, fan_in)


def location_scale(df: DataFrame, names: Sequence[str]
                   ) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Row count, means, population sds (a zero becomes 1), and which columns vary."""
    rows = {r["feature"]: r for r in column_stats(df, names).collect()}
    n = max(r["n"] for r in rows.values())
    if any(r["n"] != n for r in rows.values()):
        raise ValueError("columns with nulls: screen or fill them first")
    mean = np.array([rows[c]["mean"] or 0.0 for c in names])
    sd = np.sqrt(np.array([rows[c]["var_pop"] or 0.0 for c in names]))
    varies = np.array([n > 0 and rows[c]["low"] < rows[c]["high"] for c in names])
    return n, mean, np.where(sd > 0, sd, 1.0), varies


def _emit_pairs(m: Matrix, sums: DataFrame, schema: str,
                finish: Callable[[np.ndarray, slice, slice], dict[str, np.ndarray]],
                n_stats: int) -> DataFrame:
    """Turns summed blocks into rows (idx_a < idx_b) on the executors."""
    blocks, _ = _block_pairs(len(m.names))
    names = np.array(m.names, dtype=object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                i, j = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                ra, rb = blocks[i], blocks[j]
                flat = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
                sums_ij = flat.reshape(n_stats, ra.stop - ra.start, rb.stop - rb.start)
                a, b = np.meshgrid(np.arange(ra.start, ra.stop), np.arange(rb.start, rb.stop),
                                   indexing="ij")
                keep = a < b
                cols = finish(sums_ij, ra, rb)
                mask = keep & cols.pop("keep", keep)
                out = {"idx_a": pa.array(a[mask], pa.int32()),
                       "idx_b": pa.array(b[mask], pa.int32()),
                       "feature_a": pa.array(names[a[mask]], pa.string()),
                       "feature_b": pa.array(names[b[mask]], pa.string())}
                for name, values in cols.items():
                    v = values[mask]
                    out[name] = pa.array(v, pa.float64(), mask=np.isnan(v))
                yield pa.RecordBatch.from_pydict(out)

    head = "idx_a int, idx_b int, feature_a string, feature_b string"
    return sums.mapInArrow(run, f"{head}, {schema}")


def correlation_matrix(df: DataFrame, names: Sequence[str], fan_in: int = FAN_IN) -> DataFrame:
    """(feature_a, feature_b, r) for idx_a < idx_b; null when a column is constant."""
    n, mean, sd, varies = location_scale(df, names)
    m = matrix(df, names)
    sums = _pair_sums(m, lambda a, b, y: [a.T @ b], 1, mean, sd, False, fan_in)

    def finish(s, ra, rb):
        r = np.clip(s[0] / n, -1.0, 1.0)
        return {"r": np.where(varies[ra][:, None] & varies[rb][None, :], r, np.nan)}

    return _emit_pairs(m, sums, "r double", finish, 1)


def correlation_edges(df: DataFrame, names: Sequence[str], threshold: float) -> DataFrame:
    """Pairs with |r| above the threshold (strictly)."""
    return correlation_matrix(df, names).filter(F.abs("r") > threshold)


def column_cosine(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cosine between columns; null when a column is all zero."""
    m = matrix(df, names)
    row = df.agg(*[F.sqrt(F.sum(quoted(c).cast("double") * quoted(c))).alias(f"n{i}")
                   for i, c in enumerate(names)]).first()
    length = np.array([v or 0.0 for v in row])
    unit = np.where(length > 0, length, 1.0)
    sums = _pair_sums(m, lambda a, b, y: [a.T @ b], 1, np.zeros(len(names)), unit, False)

    def finish(s, ra, rb):
        live = (length[ra] > 0)[:, None] & (length[rb] > 0)[None, :]
        return {"cosine": np.where(live, s[0], np.nan)}

    return _emit_pairs(m, sums, "cosine double", finish, 1)


def univariate_f(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per column over the rows with a target: r, F = r^2/(1-r^2)(n-2) and its p-value."""
    train = df.filter(F.col(TARGET).isNotNull())
    y = F.col(TARGET)
    row = train.agg(F.count(y).alias("n"), *[F.corr(quoted(c).cast("double"), y).alias(f"r{i}")
                                             for i, c in enumerate(names)]).first()
    n = row[0]
    r = np.array([np.nan if v is None else v for v in row[1:]], dtype=float)
    f, p = _f_and_p(r, n - 2)
    rows = [(i, c, n, *[None if np.isnan(v) else float(v) for v in (r[i], f[i], p[i])])
            for i, c in enumerate(names)]
    return df.sparkSession.createDataFrame(
        rows, "idx int, feature string, n long, r double, f_stat double, p_value double")


def _f_and_p(r: np.ndarray, dof: float) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore", invalid="ignore"):
        f = r * r / (1.0 - r * r) * dof
    f = np.where(np.isinf(f), np.finfo(float).max, f)
    return f, f_tail(f, dof)


def interaction_screen(df: DataFrame, names: Sequence[str], alpha: float | None = 0.01,
                       mode: str = "univariate", screen_on: str = "raw",
                       fan_in: int = FAN_IN) -> DataFrame:
    """Tests the product of every column pair against the target, over rows that have one.

    ``univariate`` correlates the product alone; ``partial`` tests it beside both parents
    and an intercept. Products are of raw or of standardised columns. ``alpha=None`` keeps
    every pair with a varying product.
    """
    if mode not in ("univariate", "partial") or screen_on not in ("raw", "scaled"):
        raise ValueError("mode: univariate or partial; screen_on: raw or scaled")
    train = df.filter(F.col(TARGET).isNotNull())
    n, mean, sd, varies = location_scale(train, [*names, TARGET])
    return screen_products(matrix(train, names), n, mean, sd, varies, alpha, mode, screen_on, fan_in)


def screen_products(m: Matrix, n: int, mean: np.ndarray, sd: np.ndarray, varies: np.ndarray,
                    alpha: float | None = 0.01, mode: str = "univariate", screen_on: str = "raw",
                    fan_in: int = FAN_IN) -> DataFrame:
    """The product screen over rows with a target that are already one array column.

    ``mean``, ``sd`` (population, a zero as 1) and ``varies`` hold the features, then the
    target, over those ``n`` rows.
    """
    if mode not in ("univariate", "partial") or screen_on not in ("raw", "scaled"):
        raise ValueError("mode: univariate or partial; screen_on: raw or scaled")
    y_mean, y_sd = mean[-1], sd[-1]
    mean, sd = mean[:-1], sd[:-1]

    def stats(a, b, y):
        t = (y - y_mean) / y_sd
        aa, bb = a * a, b * b
        return [a.T @ b, aa.T @ bb, (a * t[:, None]).T @ b, aa.T @ b, a.T @ bb,
                np.repeat((a.T @ t)[:, None], b.shape[1], 1),
                np.repeat((b.T @ t)[None, :], a.shape[1], 0)]

    sums = _pair_sums(m, stats, 7, mean, sd, True, fan_in)

    def finish(s, ra, rb):
        ab, aabb, aby, aab, abb, ay, by = s / n
        # moments of u = a*b over standardised a, b (mean 0, variance 1)
        var_u, cov_ua, cov_ub, cov_uy = aabb - ab * ab, aab, abb, aby
        ones_a = varies[ra].astype(float)[:, None] * np.ones_like(ab)
        ones_b = varies[rb].astype(float)[None, :] * np.ones_like(ab)
        if mode == "partial":
            r, dof = _partial_r(ab, ones_a, ones_b, var_u, cov_ua, cov_ub, ay, by, cov_uy), n - 4
        else:
            if screen_on == "scaled":
                ku, ka, kb = 1.0, 0.0, 0.0
            else:  # raw a*b = sd_a sd_b u + sd_a mean_b a + mean_a sd_b b + constant
                sa, sb = sd[ra][:, None], sd[rb][None, :]
                ma, mb = mean[ra][:, None], mean[rb][None, :]
                ku, ka, kb = sa * sb, sa * mb, ma * sb
            var = (ku * ku * var_u + ka * ka * ones_a + kb * kb * ones_b
                   + 2 * (ku * ka * cov_ua + ku * kb * cov_ub + ka * kb * ab))
            floor = 1e-12 * (ku * ku * aabb + ka * ka + kb * kb)
            cov = ku * cov_uy + ka * ay + kb * by
            with np.errstate(divide="ignore", invalid="ignore"):
                r = np.where(var > floor, cov / np.sqrt(var), np.nan)
            dof = n - 2
        r = np.clip(r, -1.0, 1.0)
        f, p = _f_and_p(r.ravel(), dof)
        f, p = f.reshape(r.shape), p.reshape(r.shape)
        keep = ~np.isnan(r) if alpha is None else (~np.isnan(r) & (p < alpha))
        return {"r": r, "f_stat": f, "p_value": p, "keep": keep}

    return _emit_pairs(m, sums, "r double, f_stat double, p_value double", finish, 7)


def _partial_r(ab, va, vb, vu, ua, ub, ay, by, uy):
    """Correlation of u and y after a and b are taken out of both; the variance of y is 1."""
    det = va * vb - ab * ab
    with np.errstate(divide="ignore", invalid="ignore"):
        wa, wb = (vb * ua - ab * ub) / det, (va * ub - ab * ua) / det
        ya, yb = (vb * ay - ab * by) / det, (va * by - ab * ay) / det
        left_u = vu - wa * ua - wb * ub
        left_y = 1.0 - ya * ay - yb * by
        cov = uy - wa * ay - wb * by
        r = cov / np.sqrt(left_u * left_y)
    return np.where((det > 1e-9) & (left_u > 1e-9 * vu) & (left_y > 1e-12), r, np.nan)


def screened_pairs(screened: DataFrame) -> list[tuple[str, str]]:
    """Surviving pairs in column order: they become columns, so the list is column-sized."""
    rows = screened.select("idx_a", "idx_b", "feature_a", "feature_b").orderBy("idx_a", "idx_b")
    return [(r["feature_a"], r["feature_b"]) for r in rows.collect()]
