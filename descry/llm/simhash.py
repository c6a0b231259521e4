"""SimHash near-duplicates: pivot distance tables over groups of equal fingerprint bits.

A pair within ``distance`` bits has equal bits in at least one of ``distance + 1`` parts of the
fingerprint; cutting the rest once more leaves keys of about 28 equal bits. Rows of a key hold
a table of Hamming distances to reference fingerprints (pivots): by the triangle inequality a
pair whose largest coordinate difference exceeds the bound cannot be within it; the others are
verified. Pivots alone cannot find the candidates: distances of unlike 64-bit fingerprints to
any reference lie within a few bits of 32, so they exclude pairs but do not order them.

A key of more than ``GROUP`` fingerprints is cut again by its remaining bits until its group
is small; 12 free bits can hold no more than 4,096 fingerprints, so this always ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm.common import DOC, TEXT, exactly, slices, stored
from descry.llm.components import components

WORDS, DISTANCE = 3, 3
SEED = 42
PIVOTS = 24  # reference fingerprints
GROUP = 4096  # fingerprints of one key that one task compares
FREE = 12  # free bits of a key that is not cut again
BLOCK = 512  # rows compared with as many at once
STEP = 1 << 18  # hashes whose bits are counted at once


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; none for a text without words."""
    parts = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in
                     zip(starts, ends[words - 1:].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        part = hashes[at:at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) for every row; a null or wordless text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, TEXT):
                fps = [fingerprint(shingle_hashes(t, words)) for t in piece.column(TEXT).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(DOC), pa.array(np.array(fps, np.uint64).view(np.int64))],
                    names=[DOC, "fp"])

    return exactly(docs, DOC, TEXT).selectExpr(f"cast({DOC} as long) {DOC}", TEXT).mapInArrow(
        run, f"{DOC} long, fp long")


def _cuts(mask: int, parts: int) -> list[int]:
    """``mask`` with one of ``parts`` runs of its free bits fixed as well."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in run) for run in np.array_split(free, parts)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints."""
    pivots = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(PIVOTS)],
                      np.uint64)
    return np.bitwise_count(fps[:, None] ^ pivots).astype(np.int8)


def links_within(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of distinct fingerprints within ``distance`` bits.

    Blocks of rows are compared by their pivot tables first; pairs already joined are not
    returned again, so there are fewer links than rows.
    """
    order = np.argsort(pivot_table(fps)[:, 0], kind="stable")
    sorted_fps, root = fps[order], np.arange(len(fps))
    near = pivot_table(sorted_fps)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a in range(0, len(fps), BLOCK):
        high = near[min(a + BLOCK, len(fps)) - 1, 0]
        for b in range(a, len(fps), BLOCK):
            if near[b, 0] - high > distance:
                break  # sorted by the first pivot: nothing further can be near
            left, right = near[a:a + BLOCK], near[b:b + BLOCK]
            may = np.ones((len(left), len(right)), bool)
            for p in range(PIVOTS):
                may &= np.abs(left[:, None, p] - right[None, :, p]) <= distance
            i, j = np.nonzero(may)
            keep = i + a < j + b
            i, j = i[keep] + a, j[keep] + b
            close = np.bitwise_count(sorted_fps[i] ^ sorted_fps[j]) <= distance
            for x, y in zip(i[close].tolist(), j[close].tolist(), strict=True):
                if (rx := top(x)) != (ry := top(y)):
                    root[max(rx, ry)] = min(rx, ry)
                    out.append((int(order[x]), int(order[y])))
    return out


def _scan(distance: int):
    """Walks rows sorted by key and links each run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(m, v, fp):
            edge = np.flatnonzero((np.diff(m) != 0) | (np.diff(v) != 0)) + 1
            src, dst = [], []
            for s, e in zip([0, *edge], [*edge, len(m)], strict=True):
                if e - s > 1:
                    for i, j in links_within(fp[s:e], distance):
                        src.append(fp[s + i])
                        dst.append(fp[s + j])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (src, dst)],
                names=["a", "b"])

        held = None
        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("m", "v", "fp")]
            cols[2] = cols[2].view(np.uint64)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = int(np.argmax(last))
            if cut:
                yield linked(*[c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None:
            yield linked(*held)

    return run


def near_links(distinct: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` whose components are those of all
    pairs within ``distance`` bits."""
    spark, nodes = distinct.sparkSession, distinct.count()
    parts = distance + 1
    masks = [m for first in _cuts(0, parts) for m in _cuts(first, parts)]
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v"))
                     for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(keys).alias("key")).select("key.m", "key.v", "fp")
    found = None
    while True:
        counts = stored(rows.groupBy("m", "v").agg(F.count("*").alias("n")).filter("n > 1"),
                        "keys", 8 * nodes)
        last = 64 - masks[0].bit_count() <= FREE  # no more than 2 ** FREE fingerprints share a key
        fits = (F.col("n") <= group) | F.lit(last)
        small = rows.join(counts.filter(fits).select("m", "v"), ["m", "v"])
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        part = (small.repartition(tasks, "m", "v").sortWithinPartitions("m", "v")
                .mapInArrow(_scan(distance), "a long, b long"))
        found = part if found is None else found.unionAll(part)
        large = counts.filter(~fits).select("m", "v")
        if large.isEmpty():
            return found
        deeper = [_cuts(m, parts) for m in masks]
        children = [(i, len(deeper[0]) * i + j, _signed(c))
                    for i, cs in enumerate(deeper) for j, c in enumerate(cs)]
        masks = [c for cs in deeper for c in cs]
        child = F.broadcast(spark.createDataFrame(children, "m int, m2 int, mask long"))
        rows = stored(rows.join(large, ["m", "v"]).join(child, "m").select(
            F.col("m2").alias("m"), F.col("fp").bitwiseAND(F.col("mask")).alias("v"), "fp"), "deeper")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE,
                    group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Fingerprints link at ``distance`` or fewer bits; ``component_id`` is the smallest doc_id
    that links reach. Copies have one fingerprint and stand for one node. Null, empty and
    wordless texts have fingerprint zero and link like others. Repeated rows come back as
    often as they are given. A null doc_id keeps its fingerprint, names no component and is
    in the component of its fingerprint (null if no row with an id is there). Other columns
    are ignored; an empty table gives an empty table.
    """
    fps = stored(fingerprints(docs, words), "fingerprints")
    rows = fps.count()
    nodes = stored(fps.groupBy("fp").agg(F.min(DOC).alias("node")), "nodes", rows)
    links = stored(near_links(nodes, distance, group).distinct(), "near", rows)
    # Fingerprints are the graph's nodes; the smallest doc_id of a component names it afterwards.
    labels = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), rows)
    named = nodes.join(labels, nodes.fp == labels.node, "left").select(
        "fp", nodes.node.alias("least"), F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = stored(named.join(least, "label").select("fp", "component_id"), "classes", rows)
    return fps.join(classes, "fp").select(
        DOC, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest doc_id (of repeated ids
    any one). Rows without doc_id cannot be told apart and all stay."""
    gone = stored(near_duplicates(docs, words, distance)
                  .filter(f"{DOC} is not null and component_id <> {DOC}")
                  .select(F.col(DOC).alias("gone")).distinct(), "gone", docs.count())
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = f"c{names.index(DOC)}"
    kept = plain.join(gone, F.col(key) == F.col("gone"), "left_anti")
    many = (exactly(docs, DOC).filter(f"{DOC} is not null").groupBy(DOC).count()
            .filter("count > 1").select(F.col(DOC).alias("gone")))
    if many.isEmpty():
        return kept.toDF(*names)
    many = stored(many, "repeated")
    once = kept.join(many, F.col(key) == F.col("gone"), "left_semi").dropDuplicates([key])
    return kept.join(many, F.col(key) == F.col("gone"), "left_anti").unionAll(once).toDF(*names)
