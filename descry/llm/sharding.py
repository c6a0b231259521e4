"""Sharding by extendible hashing: a bucket that is too large splits on its next hash bit.

A document's bits are the first 60 of the MD5 of its id. A bucket is a prefix of bits; it is a
shard if its texts fit the limit (or it holds one document) while its parent's do not. Both
are sums over prefixes, so no bucket is ever gathered: documents are summed at a depth a
little below the expected one, the sums give all shallower buckets, and only what is still too
large there goes on to deeper bits. Rows of one id cannot be told apart by its bits; where
they exceed the limit, bits of the row's own number follow.

DataFrame expressions throughout; the directory has a few rows for every shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.llm.common import DOC, TEXT, exactly, stored

LIMIT = 1 << 20  # bytes of text in a shard: the unit that a loader shuffles and prefetches
BITS = 60
AHEAD = 3  # bits beyond the expected depth in the first sum
STEP = 8  # further bits at a time for what is still too large


def _bits(value: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as zeros and ones."""
    head = F.conv(F.substring(F.md5(value.cast("binary")), 1, BITS // 4), 16, 2)
    return F.lpad(head, BITS, "0")


def assigned(rows: DataFrame, limit: int) -> DataFrame:
    """(row, doc_id, shard, depth, shard_bytes, bytes) for stored (row, doc_id, bytes)."""
    key = F.coalesce(F.col(DOC).cast("string"), F.lit(""))
    rest = rows.withColumn("bits", _bits(key))
    total, count = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    low, depth, out = 0, min(BITS, max(0, math.ceil(math.log2(max(total / limit, 1)))) + AHEAD), None
    while True:
        base = stored(rest.groupBy(F.substring("bits", 1, depth).alias("p"))
                      .agg(F.sum("bytes").alias("b"), F.count("*").alias("n")), "buckets", count)
        levels = base.select("p", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("d")) \
            .select("p", "b", "n", "d", F.expr("substring(p, 1, d)").alias("prefix"))
        fits = (levels.groupBy("d", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n"))
                .filter((F.col("shard_bytes") <= limit) | (F.col("n") == 1) | (F.col("d") == 2 * BITS)))
        shards = (levels.select("p", "d", "prefix").join(fits.drop("n"), ["d", "prefix"])
                  .groupBy("p").agg(F.min(F.struct("d", "shard_bytes")).alias("leaf")))
        shards = stored(shards.select("p", F.col("leaf.d").alias("depth"), "leaf.shard_bytes"), "directory", count)
        placed = (rest.withColumn("p", F.substring("bits", 1, depth)).join(shards, "p")
                  .select("row", DOC, F.expr("substring(bits, 1, depth)").alias("shard"), "depth",
                          "shard_bytes", "bytes"))
        out = placed if out is None else out.unionAll(placed)
        large = base.join(shards, "p", "left_anti").select("p")
        if large.isEmpty():
            return out
        rest = rest.withColumn("p", F.substring("bits", 1, depth)).join(large, "p", "left_semi").drop("p")
        if depth == BITS:
            rest = rest.withColumn("bits", F.concat("bits", _bits(F.concat_ws(":", key, "row"))))
        rest = stored(rest, "split")
        low, depth = depth + 1, min(depth + STEP, BITS if depth < BITS else 2 * BITS)


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, shard, depth, shard_bytes, bytes) of every document.

    ``shard`` is the prefix of bits, empty if everything fits one shard; ``bytes`` is the
    UTF-8 length of the text, 0 for a null one. A document above the limit has a shard of its
    own. Null ids count as the empty string; repeated rows stay together as long as they fit.
    Other columns are ignored; an empty table gives an empty table.
    """
    rows = exactly(docs, DOC, TEXT).select(
        F.monotonically_increasing_id().alias("row"), DOC,
        F.coalesce(F.octet_length(TEXT), F.lit(0)).cast("long").alias("bytes"))
    return assigned(stored(rows, "sizes"), limit).drop("row")


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """Writes ``docs`` as Parquet files, one folder ``shard=b<bits>`` for each shard
    (``_shard`` if ``docs`` has a column of that name)."""
    label = "shard"
    while label in docs.columns:
        label = "_" + label
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = stored(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    key, text = names[docs.columns.index(DOC)], names[docs.columns.index(TEXT)]
    sizes = own.select("row", F.col(key).alias(DOC),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    where = assigned(sizes, limit).select("row", F.concat(F.lit("b"), "shard").alias("in_shard"))
    made = own.join(where, "row").drop("row").repartition("in_shard")
    made.toDF(*docs.columns, label).write.partitionBy(label).parquet(folder)


#: The same directory for DuckDB: for every document the shortest prefix that fits.
SHARDS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes,
                  lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits
           FROM documents),
p AS (SELECT d.*, depth::INTEGER AS depth, substr(bits, 1, depth::INTEGER) AS prefix
      FROM d, unnest(range(0, 41)) AS t(depth)),
f AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes FROM p GROUP BY depth, prefix
      HAVING sum(bytes) <= {LIMIT} OR count(*) = 1),
m AS (SELECT p.doc_id, p.bytes, f.depth, f.prefix, f.shard_bytes,
             row_number() OVER (PARTITION BY p.doc_id ORDER BY f.depth) AS r
      FROM p JOIN f ON f.depth = p.depth AND f.prefix = p.prefix)
SELECT doc_id, prefix AS shard, depth, shard_bytes, bytes FROM m WHERE r = 1
"""
