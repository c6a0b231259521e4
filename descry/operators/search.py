"""Correlation groups and mixed stepwise search.

The search state is a set of column names on the driver. Scoring a batch of candidates is one
job over fold moments (ridge) or over the rows (support-vector regression).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry import FEATURES, ID, TARGET
from descry.operators.linear import (FOLDS, Fit, Loss, _fold_matrix, fit_reweighted, fold_error,
                                     grams, linear_svr, solve_gram, train_matrix)
from descry.operators.blocks import Matrix, add_up, array_at, dense, gather_sums, sums_batch, values_of
from descry.operators.trees import subset
from descry.session import cut_lineage, max_tasks

BATCH, GROWTH, PATIENCE = 100, 50, 15  # fixed values of the search


def correlation_groups(names: Sequence[str], edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Greedy groups in column order from pairs above the threshold.

    A column not yet placed leads a group: its correlated later columns, then itself. A later
    column may join several groups.
    """
    later: dict[str, list[str]] = {n: [] for n in names}
    order = {n: i for i, n in enumerate(names)}
    for a, b in edges:
        first, second = (a, b) if order[a] < order[b] else (b, a)
        later[first].append(second)
    placed: set[str] = set()
    groups = []
    for name in names:
        if name in placed:
            continue
        members = sorted(later[name], key=order.__getitem__)
        placed.update(members)
        placed.add(name)
        groups.append([*members, name])
    return groups


def groups_table(spark: SparkSession, groups: list[list[str]]) -> DataFrame:
    return spark.createDataFrame(
        [(g, f, i) for g, members in enumerate(groups) for i, f in enumerate(members)],
        "group_id int, feature string, position int")


def representatives(groups: DataFrame, which: str = "first_listed") -> DataFrame:
    """(group_id, feature): the first listed member, or the leader (listed last)."""
    if which == "first_listed":
        return groups.filter("position = 0").select("group_id", "feature")
    last = F.max_by("feature", "position")
    return groups.groupBy("group_id").agg(last.alias("feature"))


def _draw(seed: str, items: Sequence[str]) -> list[str]:
    """A seeded order that does not depend on the machine."""
    return sorted(items, key=lambda v: (md5(f"{seed}|{v}".encode()).hexdigest(), v))


def init_features(groups: list[list[str]], n: int, seed: int) -> set[str]:
    """One member each of ``n`` random groups."""
    chosen = _draw(f"{seed}|groups", [str(i) for i in range(len(groups))])[: min(n, len(groups))]
    return {_draw(f"{seed}|member|{g}", groups[int(g)])[0] for g in chosen}


def best_candidate(scores: DataFrame) -> DataFrame:
    """The smallest score; ties go to the first name."""
    return scores.agg(F.min(F.struct("score", "feature")).alias("best")).select(
        "best.feature", "best.score")


class RidgeScorer:
    """Mean held-out RMSE from fold moments; rows are read once, in the constructor.

    Each fold keeps its own and its complement's moments as one row of a table, so a batch is
    scored where the moments are. The cost of a batch does not depend on the rows.
    """

    def __init__(self, m: Matrix, repeats: int, n_splits: int, alpha: float = 1.0):
        self.names, self.alpha = m.names, alpha
        self.size = len(m.names) + 2
        found = cut_lineage(grams(train_matrix(m), repeats, n_splits))
        # the folds of one repeat are all rows; they are added up by the cluster
        first = found.filter("repeat = 0").select(F.lit(0).alias("key"), "sums")
        total = np.array(add_up(first, ["key"], n_splits).first()["sums"])

        def complement(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                rest = [total - array_at(batch, "sums", i) for i in range(len(batch))]
                yield batch.append_column("rest", pa.array(rest, pa.list_(pa.float64())))

        schema = "repeat int, fold int, sums array<double>, rest array<double>"
        self.n_folds = repeats * n_splits
        self.folds = cut_lineage(found.repartition(self.n_folds).mapInArrow(complement, schema))

    def scores(self, sets: dict[str, Sequence[str]]) -> DataFrame:
        """(feature, score) per named set of columns."""
        position = {n: i for i, n in enumerate(self.names)}
        todo = [(k, [position[n] for n in sorted(v, key=position.__getitem__)])
                for k, v in sets.items()]
        cores = self.folds.sparkSession.sparkContext.defaultParallelism
        lanes = max(1, min(len(todo), cores // self.n_folds))
        size, alpha = self.size, self.alpha

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    g = array_at(batch, "sums", i).reshape(size, size)
                    rest = array_at(batch, "rest", i).reshape(size, size)
                    mine = todo[batch.column("lane")[i].as_py()::lanes]
                    rmse = []
                    for _, cols in mine:
                        w, b = solve_gram(rest, cols, alpha)
                        rmse.append(float(np.sqrt(fold_error(g, cols, w, b) / g[0, 0])))
                    yield pa.RecordBatch.from_pydict({
                        "feature": pa.array([k for k, _ in mine], pa.string()),
                        "rmse": pa.array(rmse, pa.float64())})

        spread = self.folds.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        if lanes > 1:
            spread = spread.repartition(self.n_folds * lanes)
        return spread.mapInArrow(run, "feature string, rmse double").groupBy("feature").agg(
            F.avg("rmse").alias("score"))


class SvrScorer:
    """Mean held-out RMSE of linear support-vector regression: all candidates and folds are
    fitted together, a pass over the rows per step."""

    def __init__(self, m: Matrix, repeats: int, n_splits: int, c: float = 1.0, tol: float = 1e-3):
        self.m, self.names = train_matrix(m), m.names
        self.keys = [(r, f) for r in range(repeats) for f in range(n_splits)]
        self.c, self.tol = c, tol

    def scores(self, sets: dict[str, Sequence[str]]) -> DataFrame:
        position = {n: i for i, n in enumerate(self.names)}
        fits, owner = [], []
        for name, columns in sets.items():
            cols = tuple(sorted(position[n] for n in columns))
            for key in self.keys:
                fits.append(Fit(cols, key))
                owner.append(name)
        models = fit_reweighted(self.m, fits, Loss("absolute", self.c), self.tol)
        w = np.zeros((len(self.names) + 1, len(fits)))
        for i, (fit, model) in enumerate(zip(fits, models, strict=True)):
            w[0, i] = model.intercept
            w[np.array(fit.cols) + 1, i] = model.coef
        held = np.array([f.held_out for f in fits])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            total = np.zeros((2, len(fits)))
            for batch in batches:
                if not len(batch):
                    continue
                e = dense(batch, w.shape[0] - 1) @ w[1:] + w[0] - values_of(batch, TARGET)[:, None]
                out = _fold_matrix(batch)[:, held[:, 0]] == held[:, 1]
                total += np.stack([(e * e * out).sum(axis=0), out.sum(axis=0)])
            yield sums_batch({"key": [0]}, [total])

        tasks = max_tasks(self.m.df.sparkSession)
        parts = self.m.df.select(FEATURES, TARGET, FOLDS).coalesce(tasks).mapInArrow(
            run, "key int, sums array<double>")
        sse, n = gather_sums(parts, ["key"], tasks, 2 * len(fits))[0,].reshape(2, -1)
        rmse = np.sqrt(sse / n)
        rows = [(o, float(v)) for o, v in zip(owner, rmse, strict=True)]
        return self.m.df.sparkSession.createDataFrame(rows, "feature string, rmse double").groupBy(
            "feature").agg(F.avg("rmse").alias("score"))


@dataclass
class SearchResult:
    features: list[str]
    score: float
    history: list[tuple[int, str, str | None, float]] = field(default_factory=list)

    def steps(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.history, "step int, move string, feature string, score double")


def _candidates_to_add(groups: list[list[str]], chosen: set[str], batch: int, seed: str) -> list[str]:
    picked: list[str] = []
    order = _draw(f"{seed}|add", [str(i) for i in range(len(groups))])[: batch * 10]
    for g in order:
        out = [f for f in groups[int(g)] if f not in chosen and f not in picked]
        if out:
            picked.append(_draw(f"{seed}|pick|{g}", out)[0])
        if len(picked) == batch:
            break
    return picked


def mixed_stepwise(scorer, groups: list[list[str]], iterations: int, start: set[str], seed: int = 0,
                   batch: int = BATCH, growth: int = GROWTH, patience: int = PATIENCE) -> SearchResult:
    """Even steps add the best of a batch, one candidate per random group; odd steps remove
    the best removal. An addition must lower the score, a removal must not raise it. Batches
    grow while nothing improves; the search stops after ``patience`` such steps."""
    chosen = set(start)

    def best(sets: dict[str, Sequence[str]]) -> tuple[str, float]:
        # one row per candidate of the batch; the same choice as ``best_candidate``
        score, feature = min((r["score"], r["feature"]) for r in scorer.scores(sets).collect())
        return feature, score

    score = best({"": sorted(chosen)})[1]
    history: list[tuple[int, str, str | None, float]] = [(-1, "start", None, score)]
    last, stalls = float("inf"), 0
    for step in range(iterations):
        stalls = stalls + 1 if score >= last else 0
        last = score
        if stalls > patience:
            break
        size = batch + growth * stalls
        label = f"{seed}|{step}"
        if step % 2 == 0:
            names = _candidates_to_add(groups, chosen, size, label)
            if not names:
                continue
            name, value = best({n: sorted(chosen | {n}) for n in names})
            if value < score:
                chosen.add(name)
                score = value
                history.append((step, "add", name, score))
        else:
            # the last removal pass already tried every feature
            covered = (stalls - 2) * growth + batch > len(chosen)
            if (stalls > 1 and covered) or len(chosen) < 2:
                continue
            names = _draw(f"{label}|remove", sorted(chosen))[:size]
            name, value = best({n: sorted(chosen - {n}) for n in names})
            if value <= score:
                chosen.remove(name)
                score = value
                history.append((step, "remove", name, score))
    return SearchResult(sorted(chosen), score, history)


def robust_runs(m: Matrix, scorer, groups: list[list[str]], runs: int, iterations: int,
                seed: int = 0, c: float = 1.0, invert=None, final=None, **options
                ) -> tuple[DataFrame, DataFrame]:
    """Searches from random starts: (run_features, run_predictions), both long.

    Start sizes lie between 5 and half the columns. Predictions are for the rows without a
    target; scores and predictions are in target units when given an inverse. ``final`` scores
    the found set for the log; give the scorer of the stored model where the search used another.
    """
    spark = m.df.sparkSession
    rng = np.random.default_rng(seed)
    top = max(5, len(m.names) // 2)
    feature_rows, predictions = [], None
    sd = invert(1.0) - invert(0.0) if invert else 1.0
    for run in range(runs):
        n = int(rng.integers(5, top + 1)) if top > 5 else min(5, len(groups))
        start = init_features(groups, n, seed * 1000 + run)
        found = mixed_stepwise(scorer, groups, iterations, start, seed=seed * 1000 + run, **options)
        picked = subset(m, found.features)
        model = linear_svr(picked, c)
        score = found.score
        if final is not None:
            score = final.scores({"": found.features}).first()["score"]
        rmse = score * sd
        feature_rows += [(run, len(found.features), rmse, f, w)
                         for f, w in zip(model.names, model.coef, strict=True)]
        value = model.array_column(picked.names)
        test = picked.df.filter(F.col(TARGET).isNull()).select(
            F.lit(run).alias("run_id"), F.lit(len(found.features)).alias("n_feats"),
            F.lit(rmse).alias("rmse"), ID,
            (value if invert is None else invert(value)).alias("prediction"))
        predictions = test if predictions is None else predictions.unionByName(test)
    features = spark.createDataFrame(
        feature_rows, "run_id int, n_feats int, rmse double, feature string, coef double")
    return features, predictions
