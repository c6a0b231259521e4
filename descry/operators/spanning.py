"""Minimum spanning trees over all row pairs (G5, G6), without writing the pairs.

An edge that is not in the tree of some part of the graph is not in the tree of the whole.
So each pair of row blocks keeps only its own tree, grown from the trees of its parts, and
Boruvka rounds join what is left.
Edges are ordered by (weight, src, dst), which makes the tree unique.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry import FEATURES, ID, TARGET
from descry.operators.blocks import Matrix
from descry.operators.similarity import (Block, _column, block_pairs, hashed_blocks, measure_matrix,
                                         several, steps)
from descry.session import cut_lineage

ROWS_PER_BLOCK = 8192  # a pair of blocks hands on as many edges as it has rows, so few large ones
SMALL = 500_000  # edges that one task may finish
ZERO = 1e-9  # rounding of a weight that is zero: no edge


def _merged(comp: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Components after each of ``one`` takes its cheapest edge to ``other``. With a strict edge
    order the choices only cycle in pairs; the smaller of a pair is the root."""
    parent = np.arange(len(comp))
    parent[one] = other
    pair = one[(parent[other] == one) & (one < other)]
    parent[pair] = pair
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent[comp]
        parent = up


def _tree(weights: np.ndarray, place: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the spanning forest's edges between the rows and the columns of a dense
    matrix (inf: no edge), or between the rows alone if they are the ``same`` as the columns; Boruvka.

    ``place`` is the order of ids, of rows and then of columns, each ascending. So of equal weights
    the first in a row or column is the least edge. A row is looked through again only when the
    partner that was its nearest has come into its own component.
    """
    p, n = len(weights), len(place)
    sides = [(np.arange(p), weights, 0)]
    if not same:
        sides = [(np.arange(p), weights, p), (np.arange(p, n), np.ascontiguousarray(weights.T), 0)]
    comp, near, gap = np.arange(n), np.zeros(n, int), np.zeros(n)
    stale = np.ones(n, bool)
    kept = []
    while stale.any():
        for own, matrix, offset in sides:
            some = np.flatnonzero(stale[own])
            cells = matrix[some]
            if kept:
                cells[comp[own[some]][:, None] == comp[offset:offset + matrix.shape[1]]] = np.inf
            at = cells.argmin(axis=1)
            near[own[some]], gap[own[some]] = at + offset, cells[np.arange(len(some)), at]
        able = np.flatnonzero(gap < np.inf)
        if not len(able):
            break
        low, high = np.minimum(place[able], place[near[able]]), np.maximum(place[able], place[near[able]])
        able = able[np.lexsort((high, low, gap[able]))]
        one, first = np.unique(comp[able], return_index=True)
        mine, theirs = able[first], near[able[first]]
        kept.append(np.column_stack([np.minimum(mine, theirs), np.maximum(mine, theirs)]))
        comp = _merged(comp, one, comp[theirs])
        stale = (gap < np.inf) & (comp[near] == comp)
    edges = np.unique(np.concatenate(kept), axis=0) if kept else np.empty((0, 2), int)
    return edges[:, 0], edges[:, 1] - (0 if same else p)


def block_trees(m: Matrix, measure: str, most: str, rows_per_block: int = ROWS_PER_BLOCK
                ) -> DataFrame:
    """Edges (src, dst, weight) that are in the tree of their pair of blocks."""
    if most not in ("similar", "different"):
        raise ValueError("most is 'similar' or 'different'")
    if measure not in ("cosine", "ratio", "interaction", "overall"):
        raise ValueError(f"no such measure: {measure}")
    width = len(m.names)
    rows = m.df.filter(F.col(TARGET).isNotNull()) if measure != "cosine" else m.df
    rows = rows.select(ID, F.coalesce(TARGET, F.lit(0.0)).alias(TARGET), FEATURES)
    n = rows.count()
    blocks = hashed_blocks(rows, n, rows_per_block, width, [TARGET])
    id_type = rows.schema[ID].dataType.simpleString()

    def part_tree(a: Block, b: Block, s: slice, t: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        same = a.block == b.block and s == t
        ids, others = a.ids[s], b.ids[t]
        x, y = np.concatenate([a.x[s], b.x[t]]), np.concatenate([a.more[0][s], b.more[0][t]])
        i = np.arange(len(ids))
        sims = measure_matrix(measure, x, y, i, np.arange(len(i), len(y)))
        part = 100.0 * ((1 - sims) if most == "similar" else sims)
        part[np.isnan(part) | (np.abs(part) < ZERO)] = np.inf
        place = i
        if same:  # one value per pair, so both halves agree exactly
            part[np.tri(len(ids), dtype=bool)] = np.inf
            part = np.minimum(part, part.T)
        else:
            place = np.empty(len(y), int)
            place[np.argsort(np.concatenate([ids, others]), kind="stable")] = np.arange(len(y))
        p, q = _tree(part, place, same)
        p, q = p[ids[p] != others[q]], q[ids[p] != others[q]]  # a row repeated with its id is one node
        one, two = ids[p], others[q]
        turned = one > two
        return np.where(turned, two, one), np.where(turned, one, two), part[p, q]

    def prune(a: Block, b: Block) -> Iterable[dict[str, np.ndarray]]:
        trees, held = [], 0
        for s, t in steps(a, b):
            trees.append(part_tree(a, b, s, t))
            held += len(trees[-1][0])
            if held > 8 * (len(a.ids) + len(b.ids)):
                trees = [_joined(trees)]
                held = len(trees[0][0])
        src, dst, weight = _joined(trees) if len(trees) > 1 else trees[0]
        yield {"src": src, "dst": dst, "weight": weight}

    return block_pairs(blocks, width, prune, f"src {id_type}, dst {id_type}, weight double", several(n, rows_per_block))


def _forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Positions of the forest's edges between a and b, ordered by (w, s, d); Boruvka."""
    order = np.lexsort((d, s, w))
    ends, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = number[:len(a)][order], number[len(a):][order]
    comp, live, kept = np.arange(len(ends)), np.arange(len(order)), []
    while True:
        live = live[comp[u[live]] != comp[v[live]]]
        if not len(live):
            return order[np.sort(np.concatenate(kept))] if kept else order[:0]
        best = np.full(len(ends), len(order))
        for end in (u, v):
            least = np.full(len(ends), len(order))
            least[comp[end[live[::-1]]]] = live[::-1]  # of repeated places the last, the least edge, stays
            best = np.minimum(best, least)
        one = np.flatnonzero(best < len(order))
        edge = best[one]
        kept.append(np.unique(edge))
        comp = _merged(comp, one, comp[u[edge]] + comp[v[edge]] - one)


def _joined(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forest of the edges of several."""
    s, d, w = (np.concatenate(c) for c in zip(*trees, strict=True))
    keep = _forest(s, d, w, s, d)
    return s[keep], d[keep], w[keep]


def _finish(left: DataFrame) -> DataFrame:
    """The forest of a bounded list of edges between components (cs, cd) in one task."""

    def whole(table: pa.Table) -> pa.Table:
        a, b, w, s, d = (_column(table, c) for c in ("cs", "cd", "weight", "src", "dst"))
        keep = _forest(a, b, w, s, d)
        return pa.table({"src": s[keep], "dst": d[keep], "weight": w[keep]})

    kind = left.schema["src"].dataType.simpleString()
    together = left.withColumn("all", F.lit(0)).groupBy("all")
    return together.applyInArrow(whole, f"src {kind}, dst {kind}, weight double")


def _spread(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by shuffle. A stored table keeps the size that was guessed for its plan; for edges
    of block pairs that is about the size of the rows, and a broadcast would pass through the driver."""
    return a.hint("merge").join(b.hint("merge"), on, how)


def _hook(best: DataFrame) -> DataFrame:
    """(comp, root) from each component's cheapest neighbour.

    With a strict edge order the choices only cycle in pairs; the smaller of a pair is the
    root. Pointers are then doubled until they all point at roots.
    """
    back = best.select(F.col("comp").alias("other"), F.col("other").alias("of_other"))
    parents = _spread(best, back, "other", "left").select(
        "comp", F.when((F.col("of_other") == F.col("comp")) & (F.col("comp") < F.col("other")),
                       F.col("comp")).otherwise(F.col("other")).alias("root"))
    while True:
        up = parents.select(F.col("comp").alias("root"), F.col("root").alias("up"))
        jumped = cut_lineage(_spread(parents, up, "root", "left").select(
            "comp", F.coalesce("up", "root").alias("new"), "root"))
        moved = jumped.filter("new <> root").limit(1).count()
        parents = jumped.select("comp", F.col("new").alias("root"))
        if not moved:
            return parents


def forest(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """Minimum spanning forest of an edge list (src < dst, weight)."""
    edges = cut_lineage(edges.select("src", "dst", "weight"))
    left = edges.select("*", F.col("src").alias("cs"), F.col("dst").alias("cd"))
    chosen = None
    n = edges.count()
    while n > small:
        ends = left.select(F.col("cs").alias("comp"), F.col("cd").alias("other"),
                           "weight", "src", "dst").unionByName(
            left.select(F.col("cd").alias("comp"), F.col("cs").alias("other"),
                        "weight", "src", "dst"))
        best = cut_lineage(ends.groupBy("comp").agg(
            F.min(F.struct("weight", "src", "dst", "other")).alias("e")
        ).select("comp", "e.other", "e.weight", "e.src", "e.dst"))
        picked = best.select("src", "dst", "weight").distinct()
        chosen = cut_lineage(picked if chosen is None else chosen.unionByName(picked))
        roots = _hook(best)
        a = roots.select(F.col("comp").alias("cs"), F.col("root").alias("rs"))
        b = roots.select(F.col("comp").alias("cd"), F.col("root").alias("rd"))
        # after joining components, keep the cheapest edge between each two of them
        merged = _spread(_spread(left, a, "cs"), b, "cd").filter("rs <> rd")
        left = cut_lineage(merged.groupBy(F.least("rs", "rd").alias("cs"),
                                          F.greatest("rs", "rd").alias("cd")).agg(
            F.min(F.struct("weight", "src", "dst")).alias("e")
        ).select("e.src", "e.dst", "e.weight", "cs", "cd"))
        n = left.count()
    if n == 0:
        return edges if chosen is None else chosen
    rest = _finish(left)
    return rest if chosen is None else chosen.unionByName(rest)


def spanning_tree(m: Matrix, measure: str = "cosine", most: str = "similar",
                  rows_per_block: int = ROWS_PER_BLOCK, small: int = SMALL) -> DataFrame:
    """(src, dst, weight, whole): the tree by one measure; weight is 100(1 - s) for the most
    similar rows, 100 s for the most different, ``whole`` its integer part. A zero weight is
    no edge, so copies are joined through others. An overall weight is a quotient by cosine + ratio,
    which may be nearly zero: its integer part does not fit 32 bits, but always 64."""
    return forest(block_trees(m, measure, most, rows_per_block), small).select(
        "src", "dst", "weight", F.col("weight").cast("bigint").alias("whole"))


def tree_rows(df: DataFrame, tree: DataFrame, columns: int = 8) -> DataFrame:
    """Rows at the ends of tree edges, with their first columns."""
    ends = tree.select(F.col("src").alias(ID)).unionByName(tree.select(F.col("dst").alias(ID)))
    return _spread(df.select(*df.columns[:columns]), ends.distinct(), ID, "left_semi")
