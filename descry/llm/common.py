"""What the text operators share: column choice, stored tables, Arrow passes and labelled folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.session import checkpoint_dir

DOC, TEXT = "doc_id", "text"
BATCH_BYTES = 8 << 20  # text handed to one Python call at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exactly(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact spelling: other columns, also such as ``TEXT`` beside
    ``text``, are never looked at."""
    where = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{where[n]}").alias(n) for n in names])


ROWS_PER_FILE = 1 << 17
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes ``df`` to the folder that the cluster shares and reads it back.

    Lineage ends there, so the loss of an executor does not repeat the work before it. With
    ``rows``, a bound of its narrow rows, the files are no more than these need. The shuffle files
    of the write are removed with its end, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    path = f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key is fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts, F.lit(0))


def place_of(*columns: str) -> Column:
    """A place in [0, 1) for every row, by hash; even rows that repeat all columns differ."""
    row = F.xxhash64(*columns, F.monotonically_increasing_id())
    return F.pmod(row, F.lit(1_000_003)) / 1_000_003


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a piece stay near ``limit`` bytes."""
    sizes = np.array([0 if v is None else v for v in
                      pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def append_columns(df: DataFrame, text: str, fields: Sequence[tuple[str, str]],
                   each: Callable[[], Callable[[Sequence[str | None]], Sequence[pa.Array]]]
                   ) -> DataFrame:
    """All columns of ``df`` and the ``fields`` that a function makes from the texts.

    ``each`` is called once per task and returns the function from texts to column arrays.
    Columns are addressed by place, so names of ``df`` may repeat those of ``fields``.
    """
    names = df.columns
    at = names.index(text)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    added = T._parse_datatype_string(", ".join(f"`x{i}` {t}" for i, (_, t) in enumerate(fields)))
    schema = T.StructType([*plain.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = each()
        for batch in batches:
            for piece in slices(batch, f"c{at}"):
                made = work(piece.column(f"c{at}").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, *made],
                    names=[*piece.schema.names, *[f"x{i}" for i in range(len(fields))]])

    return plain.mapInArrow(run, schema)


def renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)
