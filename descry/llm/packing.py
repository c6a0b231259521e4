"""Best-fit packing of token sequences by linear grouping.

A plan is made from the histogram of piece lengths alone, at most ``size`` numbers whatever
the corpus. Large lengths are sorted and cut into groups of equal numbers of pieces; each is
rounded up to the longest of its group. For these few sizes the fractional packing of fewest
sequences is found by column generation (a configuration is a set of sizes that fits; new
ones come from a knapsack over the dual prices). Whole multiples of the configurations are
used; actual lengths replace the rounded ones; the rest is packed best-fit, longest first, and
so are the small pieces, into the room that is left. Rounding costs room where small pieces
are scarce, so a few numbers of groups are tried, down to none (all pieces count as small),
and the plan of fewest sequences is kept.

Sequences with equal contents are one line of the plan with a multiplicity. Pieces are
numbered within their length by two-level counts, and looked up in the plan by number.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from descry.llm.common import DOC, TEXT, exactly, slices, stored
from descry.llm.encoding import encoder, end_mark, tokenizer_path

SIZE = 1024  # tokens of a sequence
END = 2
TOKENIZER = "byte_bpe_50k.json"
GROUPS = (96, 32, 0)  # numbers of rounded sizes that are tried
LARGE = 16  # pieces above size / LARGE count as large


@dataclass
class Line:
    """``count`` sequences that hold pieces of these ``lengths``."""

    lengths: list[int]
    count: int


def grouped(counts: np.ndarray, least: int, groups: int) -> np.ndarray:
    """For each length, the length it is rounded up to: the longest of its group. Groups hold
    about equal numbers of the pieces longer than ``least``."""
    up = np.zeros(len(counts), np.int64)
    total, seen, top = int(counts[least + 1:].sum()), 0, 0
    if not total:
        return up
    share = total / groups
    for length in range(len(counts) - 1, least, -1):
        if not counts[length]:
            continue
        if not top or seen >= share:
            top, seen = length, 0
        up[length] = top
        seen += int(counts[length])
    return up


def knapsack(sizes: np.ndarray, prices: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of ``sizes`` that fits into ``size``."""
    best, choice = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(int(sizes.min()), size + 1):
        fits = sizes <= room
        value = np.where(fits, best[room - np.minimum(sizes, room)] + prices, -1.0)
        i = int(value.argmax())
        best[room], choice[room] = best[room - 1], -1
        if value[i] > best[room] + 1e-12:
            best[room], choice[room] = value[i], i
    out, room = np.zeros(len(sizes), np.int64), size
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        out[choice[room]] += 1
        room -= int(sizes[choice[room]])
    return float(best[size]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, size: int, rounds: int = 2000
                   ) -> list[tuple[np.ndarray, float]]:
    """The fractional packing of fewest sequences, as (configuration, how many).

    The simplex method over the basis inverse; the entering column is the knapsack's answer.
    Stopping after ``rounds`` still gives a packing that covers the demand.
    """
    k = len(sizes)
    basis = np.diag(size // sizes).astype(float)
    inverse = np.diag(1.0 / (size // sizes))
    x = demand / (size // sizes)
    for _ in range(rounds):
        prices = np.ones(k) @ inverse
        value, column = knapsack(sizes, np.maximum(prices, 0.0), size)
        column = np.where(prices > 0, column, 0).astype(float)
        if value <= 1 + 1e-7:
            break
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1.0), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        step = ratio[out]
        x = x - step * d
        x[out] = step
        x = np.maximum(x, 0.0)
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
    return [(basis[:, i].astype(np.int64), float(x[i])) for i in range(k) if x[i] > 1e-9]


def best_fit(lines: list[Line], counts: np.ndarray, size: int) -> list[Line]:
    """Puts the pieces that ``counts`` still holds into the fullest lines with room, longest
    first; what fits nowhere opens new sequences."""
    rooms: dict[int, list[Line]] = {}
    for line in lines:
        if line.count:
            rooms.setdefault(size - sum(line.lengths), []).append(line)
    order = sorted(rooms)

    def put(line: Line) -> None:
        room = size - sum(line.lengths)
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append(line)

    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            i = bisect.bisect_left(order, length)
            if i == len(order):
                each = min(size // length, left)
                many = left // each
                put(Line([length] * each, many))
                left -= each * many
                continue
            room = order[i]
            line = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(i)
            each = min(room // length, left)  # the same line is the fullest until it has no room
            many = min(line.count, left // each)
            if many < line.count:
                put(Line(list(line.lengths), line.count - many))
            put(Line(line.lengths + [length] * each, many))
            left -= each * many
    return [line for held in rooms.values() for line in held if line.count]


def substituted(pattern: list[int], many: int, groups: dict[int, list[list[int]]]) -> list[Line]:
    """``many`` sequences of a configuration with actual lengths, in runs of equal contents.

    ``groups`` holds [length, left] stacks, longest on top, and is used up."""
    out = []
    while many:
        need: dict[int, int] = {}
        lengths = []
        run = many
        for rounded in pattern:
            stack = groups[rounded]
            skip, at = need.get(rounded, 0), len(stack) - 1
            # The i-th use of a size in a sequence takes the length that is i-th from the top.
            while at >= 0 and stack[at][1] <= skip:
                skip -= stack[at][1]
                at -= 1
            if at < 0:
                return out
            lengths.append(stack[at][0])
            need[rounded] = need.get(rounded, 0) + 1
        taken: dict[int, int] = {}
        for length in lengths:
            taken[length] = taken.get(length, 0) + 1
        for rounded in need:
            for length, left in groups[rounded]:
                if length in taken:
                    run = min(run, left // taken[length])
        run = max(run, 1)
        for rounded in need:
            for entry in groups[rounded]:
                entry[1] -= run * taken.get(entry[0], 0)
            groups[rounded] = [e for e in groups[rounded] if e[1] > 0]
        out.append(Line(lengths, run))
        many -= run
    return out


def plan(counts: np.ndarray, size: int = SIZE, groups: tuple[int, ...] = GROUPS,
         large: int = LARGE) -> list[Line]:
    """Lines that hold every piece once; ``counts[n]`` is the number of pieces of length n."""
    return min((grouped_plan(counts, size, g, large if g else 1) for g in groups),
               key=lambda lines: sum(line.count for line in lines))


def grouped_plan(counts: np.ndarray, size: int, groups: int, large: int) -> list[Line]:
    """The plan with one number of groups for the pieces above ``size / large``."""
    counts = np.array(counts, np.int64)
    lines = [Line([size], int(counts[size]))] if counts[size] else []
    counts[size] = 0
    least = size // large
    up = grouped(counts, least, groups)
    sizes = np.array(sorted({int(u) for u in up if u}), np.int64)
    if len(sizes):
        demand = np.array([int(counts[up == s].sum()) for s in sizes])
        stacks = {int(s): [[n, int(counts[n])] for n in np.flatnonzero(up == s) if counts[n]]
                  for s in sizes}
        for column, x in configurations(sizes, demand.astype(float), size):
            pattern = [int(s) for s, n in zip(sizes, column, strict=True) for _ in range(int(n))]
            lines += substituted(pattern, int(x + 1e-9), stacks)
        counts[least + 1:] = 0
        for stack in stacks.values():
            for length, left in stack:
                counts[length] = left
    return best_fit(lines, counts, size)


@dataclass(frozen=True)
class Places:
    """For each length, where numbered pieces go: runs of numbers share one slot of a line."""

    starts: dict[int, np.ndarray]
    firsts: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = length == n
            run = np.searchsorted(self.starts[n], number[at], "right") - 1
            sequence[at] = self.firsts[n][run] + number[at] - self.starts[n][run]
            offset[at] = self.offsets[n][run]
        return sequence, offset


def places(lines: list[Line]) -> Places:
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for line in lines:
        offset = 0
        for length in line.lengths:
            start = used.get(length, 0)
            runs.setdefault(length, []).append((start, first, offset))
            used[length] = start + line.count
            offset += length
        first += line.count
    column = lambda i: {n: np.array([r[i] for r in rs], np.int64) for n, rs in runs.items()}
    return Places(column(0), column(1), column(2))


def pieces_of(ids: bytes, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document; the first piece of a longer one takes the rest."""
    total = len(ids) // 4
    cut = total if total <= size else total % size or size
    start, piece = 0, 0
    while start < total:
        yield piece, start, cut - start, zlib.crc32(ids[4 * start:4 * cut])
        piece, start, cut = piece + 1, cut, cut + size


def document_pieces(docs: DataFrame, encode: Callable[[], Callable[[str | None], bytes]], size: int
                    ) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, number): ``number`` counts the pieces of
    a length within its task ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = encode(), TaskContext.get().partitionId()
        used = np.zeros(size + 1, np.int64)
        for batch in batches:
            for chunk in slices(batch, TEXT):
                rows: list[tuple] = []
                for doc, text in zip(chunk.column(DOC).to_pylist(), chunk.column(TEXT).to_pylist(),
                                     strict=True):
                    for piece, start, length, crc in pieces_of(ids_of(text), size):
                        rows.append((doc, piece, start, length, crc, part, int(used[length])))
                        used[length] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)] if rows
                    else [pa.array([], k) for k in kinds],
                    names=[DOC, "piece", "start", "length", "ids_crc32", "part", "number"])

    return exactly(docs, DOC, TEXT).selectExpr(f"cast({DOC} as long) {DOC}", TEXT).mapInArrow(
        run, f"{DOC} long, piece int, start long, length long, ids_crc32 long, part int, number long")


def placed(pieces: DataFrame, size: int, groups: tuple[int, ...]) -> DataFrame:
    """Adds sequence_id and offset to stored pieces."""
    heads = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")
                             .rowsBetween(Window.unboundedPreceding, -1))
    heads = stored(heads.select("part", "length", "n", F.coalesce(before, F.lit(0)).alias("before")),
                   "heads", pieces.count())
    counts = np.zeros(size + 1, np.int64)
    for length, n in heads.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        counts[length] = n
    where = pieces.sparkSession.sparkContext.broadcast(places(plan(counts, size, groups)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "number", "before")}
            sequence, offset = where.value.of(at["length"], at["number"] + at["before"])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in (DOC, "piece", "start", "length", "ids_crc32")],
                 pa.array(sequence), pa.array(offset)],
                names=[DOC, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    joined = pieces.join(heads.drop("n"), ["part", "length"])
    return joined.select(DOC, "piece", "start", "length", "ids_crc32", "number", "before").mapInArrow(
        assign, f"{DOC} long, piece int, start long, length long, ids_crc32 long, "
                "sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, byte_level: bool = True, end: int = END,
         size: int = SIZE, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text and ``end``; null and empty texts are the end id
    alone. Only documents above ``size`` are cut. Null doc_ids and repeated rows are packed
    like any other; other columns are ignored; an empty table gives an empty table.
    """
    path, mark = tokenizer or tokenizer_path(TOKENIZER), end_mark(end)

    def encode():
        known = encoder(path, byte_level)
        return lambda text: known.ids(text) + mark

    return placed(stored(document_pieces(docs, encode, size), "pieces"), size, groups)
