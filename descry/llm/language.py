"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three lower-case characters are hashed into ``BUCKETS`` features. Their
document frequencies come from all training documents; the weights are fitted with
follow-the-regularised-leader and elastic-net penalties on a bounded sample of labelled
documents (``sample`` per language), and a temperature is fitted on the part of the sample
that the weights did not see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm.common import DOC, TEXT, append_columns, exactly, fold_of, place_of, slices

BUCKETS = 1 << 16
GRAMS = 3
SAMPLE = 800  # labelled documents of a language that the weights are fitted on
SCALE = 32.0  # brings a document's TF-IDF values near one
STEP = 1 << 18  # characters hashed at once
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def gram_ids(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a whole text, piece by piece; pieces overlap so that none is lost."""
    lowered = text.lower()
    for at in range(0, max(len(lowered), 1), STEP):
        piece = lowered[at:at + STEP + GRAMS - 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        own = min(STEP, len(lowered) - at)
        rolled, found = np.zeros(len(codes), np.uint32), []
        for n in range(GRAMS):
            width = len(codes) - n
            if width <= 0:
                break
            rolled = rolled[:width] * np.uint32(MULTIPLIERS[3]) + codes[n:] * np.uint32(MULTIPLIERS[n])
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(MULTIPLIERS[0]) + np.uint32(n)
            found.append((mixed >> np.uint32(16))[:own])
        yield np.concatenate(found) if found else np.empty(0, np.uint32)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(BUCKETS, np.int64)
    for ids in gram_ids(text):
        counts += np.bincount(ids, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass(frozen=True)
class LanguageModel:
    """``weights`` holds IDF times weight; ``temperature`` divides the logits."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str | None) -> np.ndarray | None:
        if text is None or not self.languages or not LETTER.search(text):
            return None
        total, n = np.zeros(len(self.languages)), 0
        for ids in gram_ids(text):
            if len(ids) > BUCKETS:
                total += np.bincount(ids, minlength=BUCKETS) @ self.weights
            else:
                total += self.weights.take(ids, axis=0).sum(axis=0, dtype=np.float64)
            n += len(ids)
        return softmax((SCALE * total / max(n, 1) + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many documents hold each feature, over all of ``docs``; one row a feature and task
    is shuffled, and the result has ``BUCKETS`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool)
        for batch in batches:
            for piece in slices(batch, TEXT):
                for text in piece.column(TEXT).to_pylist():
                    seen[:] = False
                    for ids in gram_ids(text):
                        seen[ids] = True
                    total += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(BUCKETS)
    for at, n in (docs.select(TEXT).mapInArrow(count, "at long, n long")
                  .groupBy("at").agg(F.sum("n")).collect()):
        out[at] = n
    return out


def labelled_sample(docs: DataFrame, sizes: dict[str, int], sample: int
                    ) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, features, counts) of about ``sample`` documents of each language.

    A document is taken by a hash, so that the sample stays near its bound even where rows
    repeat; every taken document is used whole.
    """
    cases = F.lit(0.0)
    for lang, n in sizes.items():
        cases = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(cases)
    taken = docs.withColumn("place", place_of(DOC, TEXT)).filter(F.col("place") < cases)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [gram_counts(t) for t in batch.column(TEXT).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([a.astype("<u4").tobytes() for a, _ in made], pa.binary()),
                 pa.array([c.astype("<u4").tobytes() for _, c in made], pa.binary()),
                 batch.column("place")], names=["lang", "at", "n", "place"])

    rows = (taken.select(TEXT, "lang", "place")
            .mapInArrow(features, "lang string, at binary, n binary, place double").collect())
    rows.sort(key=lambda r: (r["place"], r["lang"], bytes(r["at"])))
    return [(r["lang"], np.frombuffer(r["at"], "<u4"), np.frombuffer(r["n"], "<u4")) for r in rows]


def fit_ftrl(data: Sequence[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 3,
             alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01
             ) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes, sparse by the L1 penalty) and unpenalised bias."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    first = np.full((BUCKETS + 1, 1), l1)
    first[-1] = 0.0

    def weights(at):
        drawn = np.maximum(np.abs(z[at]) - first[at], 0.0)
        return -np.sign(z[at]) * drawn / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for label, at, x in data:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_language(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learns from (doc_id, text, lang) rows; rows with a null text or lang teach nothing."""
    docs = exactly(docs, DOC, TEXT, "lang").filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1 + sum(sizes.values())) / (1 + document_frequencies(docs))) + 1
    data = [(languages.index(lang), at, SCALE * idf[at] * n / max(int(n.sum()), 1))
            for lang, at, n in labelled_sample(docs, sizes, sample)]
    held, used = data[::5], [d for i, d in enumerate(data) if i % 5] or data
    w, bias = fit_ftrl(used, len(languages))
    logits = np.array([x @ w[at] + bias for _, at, x in held]).reshape(-1, len(languages))
    temperature = calibrated(logits, np.array([label for label, _, _ in held]))
    return LanguageModel(languages, (idf[:, None] * w).astype(np.float32), bias, temperature)


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs``, then the predicted language and its probability, by place.

    A null text, and one without any letter, is ``und`` with score 0; so is every text when
    nothing was learned. Empty tables stay empty; repeated rows are answered alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def each():
        model = shared.value

        def predict(texts):
            names, scores = [], []
            for text in texts:
                p = model.probabilities(text)
                best = None if p is None else int(p.argmax())
                names.append(UNDETERMINED if best is None else model.languages[best])
                scores.append(0.0 if best is None else float(p[best]))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return predict

    return append_columns(docs, TEXT, [("lang_pred", "string"), ("score", "double")], each)


def identify(docs: DataFrame, parts: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document.

    Learns from documents whose crc32(doc_id) modulo ``parts`` is not ``held``. A null doc_id
    counts as remainder 0. Other columns are ignored.
    """
    fold = fold_of(DOC, parts) == held
    model = fit_language(exactly(docs, DOC, TEXT, "lang").filter(~fold), sample)
    made = with_language(exactly(docs, DOC, TEXT), model).toDF(DOC, TEXT, "lang_pred", "score")
    return made.select(DOC, fold.alias("held_out"), "lang_pred", "score")


def in_a_language(docs: DataFrame, least: float = 0.3, parts: int = 4, held: int = 2,
                  sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those whose language is undetermined or has a score below ``least``."""
    model = fit_language(exactly(docs, DOC, TEXT, "lang").filter(fold_of(DOC, parts) != held), sample)
    made = with_language(docs, model)
    lang, score = made.columns[-2:]
    return (made.filter((F.col(lang) != UNDETERMINED) & (F.col(score) >= least))
            .drop(lang, score).toDF(*docs.columns))
