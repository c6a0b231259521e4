"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

Every document d of source s gets a rate r_d: how many times the mix takes it. Entropy
balancing chooses the rates closest to taking every document once (least relative entropy
sum r log r - r + 1) such that each source's words come to its target:

    sum over d in s of size_d * r_d = T_s.

The convex dual is min over lambda of sum_d size_d * exp(lambda_s(d)) - sum_s lambda_s * T_s, and
its solution tilts every rate exponentially: r_d = exp(lambda_s(d)). The constraints are one per
source, so the dual's Hessian is diagonal and its sums are the per-source word totals: one
aggregation over the documents gives them (partial on the map side, so a source with a third
of all rows is added up by every task), and Newton steps then run for all sources at once as
one higher-order SQL expression per source row. Its residual is reported.

Rates are rounded into whole copies that reruns repeat: a document takes floor(r) or
ceil(r) copies, the extra ones dealt systematically along the source's documents ordered by
size, then hash. Every run of that order holds its fractions' sum of extra copies to within
one, so a source's taken words miss its target by less than about its longest document; of
32 starts of the rounding each source keeps the one that comes nearest. The
running sums are windows over (source, size, top hash bits) groups with offsets from a table
of group sums, so no window holds a hot source whole.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own,
after all others; null doc_ids stay rows of their own; repeated rows get equal copies; an
empty table gives an empty result; other columns, also with names like ``TEXT``, are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.llm.common import DOC, TEXT, exactly, stored

SOURCE = "source"
#: The weights of the sources in code-point order of their names (null last), repeating.
WEIGHTS = (5, 2, 1)
CAP = 3  # no document is taken more than three times, so no source beyond three times its size
NEWTON_STEPS = 80
SALT_BITS = 8  # a size of a source is cut in 256 ranges of the hash, so no running sum holds a hot source
#: Starts of the systematic rounding; each source keeps the one whose words come nearest its target.
STARTS = tuple((j + 0.5) / 32 for j in range(32))
SNAP = 1e-9  # rates this close to a whole number are that number
BROADCAST_SOURCES = 1 << 20  # source tables up to this many rows are broadcast; larger ones shuffle
GAP = "\\x20\\x09-\\x0D"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\t to \\r; null text: 0."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{GAP}]+", "x")
    return F.length(F.regexp_replace(marked, f"[{GAP}]+", "")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: its words, weight, target and the Newton solution of its rate.

    Targets share all words by weight; a target above ``cap`` times its source's words stops
    there and the excess goes to the others by weight until none is above. That is the level
    L with sum_s min(cap * S_s, w_s * L) = total, found in one pass over the sources ordered
    by cap * S_s / w_s: the first k whose level, with all sources before k stopped, does not
    stop source k.
    """
    totals = sized.groupBy(SOURCE).agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col(SOURCE).asc_nulls_last())))
    table = F.array(*[F.lit(w) for w in weights])
    weighted = ranked.withColumn("weight", F.element_at(table, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
                                 ).withColumn("stop", F.col("source_size") * cap / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("stop", "rank")
    levels = (weighted
              .withColumn("total", F.sum("source_size").over(everything))
              .withColumn("stopped", F.coalesce(F.sum(F.col("source_size") * cap).over(
                  order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open")))
    first = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level"))).over(everything)
    targets = (levels.withColumn("level", first["level"])
               .withColumn("target", F.least(F.col("source_size").cast("double") * cap,
                                             F.col("weight") * F.col("level"))))
    return newton_rates(targets, cap)


def newton_rates(targets: DataFrame, cap: int) -> DataFrame:
    """lambda_s by Newton's method on the dual, from 0; ``residual`` is the last gradient over
    the target. A source without words, or with no target, takes nothing."""
    newton = F.expr(
        f"aggregate(sequence(1, {NEWTON_STEPS}), 0D, (lam, i) -> "
        "CASE WHEN abs(source_size * exp(lam) - target) <= 1e-15 * target THEN lam "
        "ELSE lam - 1 + target / (source_size * exp(lam)) END)")
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    rate = F.least(F.lit(float(cap)), F.exp("lam"))
    snapped = F.when(F.abs(rate - F.rint(rate)) < SNAP, F.rint(rate)).otherwise(rate)
    return (targets.withColumn("lam", F.when(live, newton))
            .withColumn("rate", F.when(live, snapped).otherwise(F.lit(0.0)))
            .withColumn("residual", F.when(live, F.abs(F.col("source_size") * F.exp("lam") - F.col("target"))
                                           / F.col("target")).otherwise(F.lit(0.0)))
            .select(SOURCE, "rank", "weight", "source_size", "target", "lam", "rate", "residual"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's words in the mix), taken
    (words the mix takes, copies counted), copies, rate, the source's Newton residual and source."""
    plain = exactly(docs, DOC, TEXT, SOURCE)
    sized = stored(plain.select(
        DOC, SOURCE, word_count(F.col(TEXT)).alias("size"),
        F.xxhash64(DOC, TEXT).alias("h")), "mix-sized")
    sources = stored(source_targets(sized, weights, cap), "mix-sources")
    small = sources.count() <= BROADCAST_SOURCES
    if small:
        sources = F.broadcast(sources)
    rated = (sized.join(sources.select(F.col(SOURCE).alias("src"), "rank", "source_size", "target", "rate",
                                       "residual"), sized[SOURCE].eqNullSafe(F.col("src")))
             .withColumn("frac", F.col("rate") - F.floor("rate"))
             .withColumn("hs", F.shiftrightunsigned("h", 64 - SALT_BITS).cast("int")))
    group = ["rank", "size", "hs"]
    running = rated.withColumn("upto", F.sum("frac").over(
        Window.partitionBy(*group).orderBy("h", DOC).rowsBetween(Window.unboundedPreceding, 0)))
    offsets = (rated.groupBy(*group).agg(F.sum("frac").alias("held"))
               .withColumn("before", F.coalesce(F.sum("held").over(
                   Window.partitionBy("rank").orderBy("size", "hs").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0.0)))
               .select(*group, "before"))
    at = F.col("before") + F.col("upto")
    dealt = stored(running.join(offsets, group).select(
        DOC, SOURCE, "rank", "size", "source_size", "target", "rate", "residual", "frac",
        F.array(*[(F.floor(at + u) - F.floor(at - F.col("frac") + u)).cast("int")
                  for u in STARTS]).alias("extras")), "mix-dealt")
    want = F.col("want")
    sums = [F.col(f"s{j}") for j in range(len(STARTS))]
    best = (dealt.groupBy("rank")
            .agg(F.sum(F.col("frac") * F.col("size")).alias("want"),
                 *[F.sum(F.col("extras")[j] * F.col("size")).alias(f"s{j}") for j in range(len(STARTS))])
            .select("rank", F.array_min(F.array(*[F.struct(F.abs(x - want), F.lit(j))
                                                  for j, x in enumerate(sums)]))["col2"].alias("start")))
    chosen = dealt.join(F.broadcast(best) if small else best, "rank")
    copies = (F.floor("rate") + F.col("extras")[F.col("start")]).cast("long")
    return chosen.select(
        DOC, "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (copies * F.col("size")).alias("taken"), copies.alias("copies"), "rate", "residual", SOURCE)
