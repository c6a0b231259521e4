"""Cross-tokenizer alignment: where two tokenizations of one text cut it at the same byte.

A text is encoded twice without special tokens (their strings inside a text are plain text):
" " + text by the byte-level BPE (A) and text by the sentencepiece BPE (B, which adds the space
itself). A token's bytes are its vocabulary entry decoded: A's letters map back to bytes,
B's pieces are UTF-8 with U+2581 for a space and <0xHH> for byte HH.

Per document the method is hash-set intersection of cumulative ends: each side's running
byte ends go into an end -> token index dictionary, the common keys (sorted) cut both id
lists into groups that cover the same bytes, and links are expanded per group: all A-B
token pairs whose byte ranges overlap, found by walking both sides of the group in step.
Over the corpus an id pair's count is the number of links holding it; every document
carries its distinct pairs with multiplicity, the counts are one aggregation (partial on the
map side, so a pair as common as " the"/"_the" is added up by every task), and each link's
count and its B id's best count come back by a join that is broadcast when the counted
pair table is small and salted otherwise.

Edge cases: null, empty and texts whose joined A or B bytes differ from " " + text (the
sentencepiece normaliser changed them) have no tokens: zeros and an empty groups string;
very long texts are encoded whole; repeated rows are documents of their own and their
links count as often; null doc_ids are kept; other columns, also with names like ``TEXT``,
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from descry.llm.common import DOC, TEXT, exactly, slices, stored
from descry.llm.encoding import LETTERS, encoder, tokenizer_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
B_RANGE = 1 << 20  # a pair is a * B_RANGE + b
BROADCAST_PAIRS = 4_000_000  # counted pair tables up to this many rows are broadcast
SALTS = 32  # otherwise each pair row meets the documents in this many salted parts
BATCH_TEXTS = 256

RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "pairs array<long>, times array<long>")


class Tokenizers:
    """Both tokenizers of a worker and the byte length and bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.chunks = encoder(a_path, True, special_as_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {letter: i for i, letter in enumerate(LETTERS)}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            try:
                self.a_bytes[i] = bytes(byte_of[c] for c in token)
            except KeyError:  # an added token: its own text
                self.a_bytes[i] = token.encode()
        self.b_bytes = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.b_lossless = self.lossless()
        self.a_len = np.array([len(v) for v in self.a_bytes], dtype=np.int64)
        # an id's decimal text with what follows it: inside a side, ending A's part of a group,
        # ending a group, ending the document
        self.a_text = [f"{i}," for i in range(len(self.a_bytes))] + [f"{i}|" for i in range(len(self.a_bytes))]
        self.b_text = ([f"{i}," for i in range(len(self.b_bytes))] + [f"{i};" for i in range(len(self.b_bytes))]
                       + [f"{i}" for i in range(len(self.b_bytes))])
        self.b_len = np.array([len(v) for v in self.b_bytes], dtype=np.int64)

    def lossless(self) -> bool:
        """Whether B leaves a text as it is but for spaces (identity normaliser, extra white
        space kept, byte fallback): then a text without U+2581 reads back whole exactly when
        its byte count does. False where the model cannot be read."""
        try:
            from sentencepiece import sentencepiece_model_pb2 as pb
        except ImportError:
            return False
        model = pb.ModelProto()
        model.ParseFromString(self.b.serialized_model_proto())
        spec = model.normalizer_spec
        return (spec.name == "identity" and not spec.remove_extra_whitespaces
                and not spec.precompiled_charsmap and model.trainer_spec.byte_fallback)

    def piece_bytes(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
        """A's ids by the chunk-remembering encoder (the tokenizer's own ids, see
        ``encoding``), B's by sentencepiece."""
        a = [np.frombuffer(self.chunks.ids(" " + t), dtype="<u4") for t in texts]
        return a, self.b.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


EMPTY = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def picked(values, keys) -> tuple:
    """values[k] for every k, at C speed."""
    return (values[keys[0]],) if len(keys) == 1 else itemgetter(*keys)(values)


def align(tok: Tokenizers, text: str | None, a_ids: np.ndarray, b_ids: list[int]):
    """n_a, n_b, n_groups, n_links, groups_sha256 and the distinct link pairs with their
    numbers, for one text and its two encodings."""
    if not text or len(a_ids) == 0 or len(b_ids) == 0:
        return EMPTY
    whole = (" " + text).encode()
    a, b = np.asarray(a_ids, np.int64), np.asarray(b_ids, np.int64)
    a_ends, b_ends = np.cumsum(tok.a_len[a]), np.cumsum(tok.b_len[b])
    # A is byte level without a normaliser, so its bytes are the text's whenever their number is;
    # so are B's for a lossless model and a text without U+2581 (which reads back as a space).
    if a_ends[-1] != len(whole) or b_ends[-1] != len(whole):
        return EMPTY
    if (not tok.b_lossless or "\u2581" in text) and b"".join(picked(tok.b_bytes, b_ids)) != whole:
        return EMPTY
    a_at = dict(zip(a_ends.tolist(), range(len(a))))
    b_at = dict(zip(b_ends.tolist(), range(len(b))))
    common = sorted(a_at.keys() & b_at.keys())
    # The last token of each group on either side, and the group of every token.
    last_a, last_b = np.array(picked(a_at, common)), np.array(picked(b_at, common))
    place_a, place_b = np.arange(len(a)), np.arange(len(b))
    group_a, group_b = np.searchsorted(last_a, place_a), np.searchsorted(last_b, place_b)
    text_a = a + (place_a == last_a[group_a]) * len(tok.a_bytes)
    text_b = b + (place_b == last_b[group_b]) * len(tok.b_bytes)
    text_b[-1] = b[-1] + 2 * len(tok.b_bytes)
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable").tolist()
    pieces = picked([*picked(tok.a_text, text_a.tolist()), *picked(tok.b_text, text_b.tolist())], order)
    # Links: every piece between consecutive ends of either side lies in one A and one B token.
    cuts = np.sort(np.concatenate([a_ends, b_ends]))  # both rise strictly: shared ends twice
    cuts = cuts[np.concatenate([[True], cuts[1:] != cuts[:-1]])]
    in_a = np.searchsorted(a_ends, cuts, side="left")
    in_b = np.searchsorted(b_ends, cuts, side="left")
    keys = np.sort(a[in_a] * B_RANGE + b[in_b])
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    pairs, times = keys[starts], np.diff(np.append(starts, len(keys)))
    digest = hashlib.sha256("".join(pieces).encode()).hexdigest()
    return len(a), len(b), len(common), len(cuts), digest, pairs, times.astype(np.int64)


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id, the counts, groups_sha256 and its distinct link pairs (a * 2^20 + b)
    with their numbers of links; the row key ``rk`` ties repeated rows to their results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(a_path, b_path)
        for batch in batches:
            for piece in slices(batch, TEXT):
                texts = piece.column(TEXT).to_pylist()
                for start in range(0, len(texts), BATCH_TEXTS):
                    chunk = texts[start:start + BATCH_TEXTS]
                    plain = [t or "" for t in chunk]
                    a_all, b_all = tok.encode(plain)
                    rows = [align(tok, t, a, b) for t, a, b in zip(chunk, a_all, b_all)]
                    offsets = np.cumsum([0] + [len(r[5]) for r in rows])
                    flat = lambda k: np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([
                        piece.column(DOC).slice(start, len(chunk)), piece.column("rk").slice(start, len(chunk)),
                        *[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)],
                        pa.array([r[4] for r in rows], pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat(5), pa.int64())),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat(6), pa.int64()))],
                        names=[DOC, "rk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    plain = exactly(docs, DOC, TEXT).withColumn("rk", F.xxhash64(DOC, TEXT))
    return plain.mapInArrow(run, RESULT.replace("doc_id long,", "doc_id long, rk long,"))


def alignment(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair count is
    the highest of any pair with their B id, ties included), count_sum (pair counts summed
    over links) and groups_sha256."""
    rows = stored(encoded(docs, tokenizer_path(a_file), tokenizer_path(b_file)), "align-rows")
    def exploded(df: DataFrame) -> DataFrame:
        return df.select("rk", DOC, F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
            "rk", DOC, F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))

    links = exploded(rows)
    counts = links.groupBy("pair").agg(F.sum("times").alias("count"))
    best = (counts.withColumn("b", F.col("pair") % B_RANGE)
            .withColumn("top", F.max("count").over(Window.partitionBy("b"))))
    scored = stored(best.select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("is_best")),
                    "align-pairs")
    once = exploded(rows.dropDuplicates(["rk", DOC]))  # a repeated row's results are its first one's
    if scored.count() <= BROADCAST_PAIRS:
        met = once.join(F.broadcast(scored), "pair")
    else:
        salt = F.pmod(F.col("rk"), F.lit(SALTS))
        spread = scored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = once.withColumn("salt", salt).join(spread, ["pair", "salt"])
    per_row = met.groupBy("rk", DOC).agg(
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
        F.sum(F.col("times") * F.col("is_best")).alias("n_best")).toDF("rk2", "doc2", "count_sum", "n_best")
    joined = rows.join(per_row, (F.col("rk") == F.col("rk2")) & F.col(DOC).eqNullSafe(F.col("doc2")), "left")
    return joined.select(
        DOC, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
