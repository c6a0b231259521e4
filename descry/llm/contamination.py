"""Benchmark decontamination: min-hash containment search, partitioned by item size.

Items and documents are sets of five-word shingles. An item of ``q`` shingles is contained at
the threshold ``t`` only if at least ``ceil(t * q)`` of them occur in the document, so at
least one of *any* ``q - ceil(t * q) + 1`` occurs there. Each item therefore stands in the
index with that many of its smallest hashes (its min-hashes); how many follows from its size
partition. A document looks up all its shingles and skips partitions whose items need more
shingles than it has. Candidates are verified on the shingles themselves.

Banded signatures of whole documents would not do: a thirty-shingle item in a document of
twenty thousand has a Jaccard similarity near 0.001 and would mostly be missed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm.common import DOC, TEXT, append_columns, exactly

WORDS, SHARE = 5, 0.8
ITEM = "item_id"
ITEM_BYTES = 32 << 20  # text of benchmark items that one pass over the documents looks for
WORD = re.compile(r"\w+")
CHAIN = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20
KNOWN = 200_000  # word hashes a task remembers


class WordHashes(dict):
    """Word to 64-bit hash; starts anew when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return value


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingle_ids(words: list[str], known: WordHashes, size: int = WORDS) -> np.ndarray:
    """A hash for every run of ``size`` words; of fewer words, one for the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    base = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(base) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * CHAIN + base[i:i + n]
    return (out ^ (out >> np.uint64(29))) * CHAIN


def shingle_texts(words: list[str], size: int = WORDS) -> list[str]:
    size = min(size, len(words))
    return [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if words else []


class ItemIndex:
    """Min-hashes of a block of items by size partition, and their shingles to verify with."""

    def __init__(self, items: list[tuple[int, str | None]], share: float, size: int):
        self.share, self.size = share, size
        self.shingles: list[tuple[int, frozenset[str]]] = []
        known = WordHashes()
        parts: dict[int, list[tuple[int, int]]] = {}
        self.least: dict[int, int] = {}
        for key, text in items:
            words = words_of(text)
            ids = np.unique(shingle_ids(words, known, size))
            q = len(ids)
            if not q:
                continue
            need = math.ceil(share * q - 1e-9)
            part = q.bit_length()
            self.least[part] = min(need, self.least.get(part, need))
            for h in ids[:q - need + 1].tolist():
                parts.setdefault(part, []).append((h, len(self.shingles)))
            self.shingles.append((key, frozenset(shingle_texts(words, size))))
        self.parts = {}
        for part, pairs in parts.items():
            pairs.sort()
            self.parts[part] = (np.array([h for h, _ in pairs], np.uint64), [i for _, i in pairs])
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        for hashes, _ in self.parts.values():
            self.maybe[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def matches(self, text: str | None, known: WordHashes) -> list[tuple[int, int, int]]:
        """(item_id, shared shingles, shingles of the item) of every contained item."""
        words = words_of(text)
        ids = shingle_ids(words, known, self.size)
        if not len(ids):
            return []
        hit = ids[self.maybe[(ids >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
        if not len(hit):
            return []
        hit = np.unique(hit)
        candidates: set[int] = set()
        for part, (hashes, items) in self.parts.items():
            if self.least[part] > len(ids):
                continue
            low, high = np.searchsorted(hashes, hit, "left"), np.searchsorted(hashes, hit, "right")
            for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
                candidates.update(items[a:b])
        if not candidates:
            return []
        own, out = set(shingle_texts(words, self.size)), []
        for i in sorted(candidates):
            key, shingles = self.shingles[i]
            shared = len(own & shingles)
            if shared >= math.ceil(self.share * len(shingles) - 1e-9):
                out.append((key, shared, len(shingles)))
        return out


def item_blocks(benchmark: DataFrame, share: float, size: int, block_bytes: int
                ) -> Iterator[Broadcast]:
    """Indexes of the items in blocks of bounded size, each broadcast in turn.

    Blocks are hash classes of the item id; there are as many as the text needs, so a larger
    benchmark takes more passes and not more memory.
    """
    items = exactly(benchmark, ITEM, TEXT).filter(f"{ITEM} is not null and {TEXT} is not null")
    total = items.agg(F.sum(F.octet_length(TEXT))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64(ITEM), F.lit(blocks)) == b).collect()
        yield items.sparkSession.sparkContext.broadcast(
            ItemIndex([(r[ITEM], r[TEXT]) for r in rows], share, size))


MATCHES = "array<struct<item_id:bigint,shared:bigint,shingles:bigint>>"


def with_matches(docs: DataFrame, index: Broadcast) -> DataFrame:
    """All columns of ``docs`` and, last, the items of one block that each document contains."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("shingles", pa.int64())]))

    def each():
        known = WordHashes()

        def find(texts):
            return [pa.array([[dict(zip(("item_id", "shared", "shingles"), m, strict=True))
                               for m in index.value.matches(t, known)] for t in texts], kind)]

        return find

    return append_columns(docs, TEXT, [("matches", MATCHES)], each)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, size: int = WORDS,
                 block_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, shared, shingles, containment): every pair at or above ``share``.

    Words are runs of letters, digits and underscores, in lower case. An item or document of
    fewer than ``size`` words is one shingle of all of them, so a short item matches only a
    document of just these words. Null or wordless texts match nothing; null item ids are left
    out; null doc_ids are reported as null. Repeated documents and items each give their pairs.
    """
    found = None
    for index in item_blocks(benchmark, share, size, block_bytes):
        part = (with_matches(exactly(docs, DOC, TEXT), index).toDF(DOC, TEXT, "matches")
                .select(DOC, F.explode("matches").alias("m")).select(DOC, "m.*"))
        found = part if found is None else found.unionAll(part)
    return found.withColumn("containment", F.col("shared") / F.col("shingles"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, size: int = WORDS,
                  block_bytes: int = ITEM_BYTES) -> DataFrame:
    """``docs`` without every document that contains a benchmark item."""
    kept = docs
    for index in item_blocks(benchmark, share, size, block_bytes):
        made = with_matches(kept, index)
        kept = made.filter(F.size(made.columns[-1]) == 0).drop(made.columns[-1]).toDF(*docs.columns)
    return kept


#: The same containment from whole shingle sets, for DuckDB.
CONTAINED_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS r, item_id,
             regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark
      WHERE text IS NOT NULL AND item_id IS NOT NULL),
ds AS (SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
       FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT r, item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
       FROM b WHERE len(w) > 0),
q AS (SELECT r, count(*) AS n FROM bs GROUP BY r)
SELECT ds.doc_id, bs.item_id, count(*) AS shared, q.n AS shingles, count(*) / q.n AS containment
FROM ds JOIN bs USING (s) JOIN q ON q.r = bs.r
GROUP BY ds.r, ds.doc_id, bs.r, bs.item_id, q.n HAVING 5 * count(*) >= 4 * q.n
"""
