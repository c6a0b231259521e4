"""Toxicity by multiple-instance learning: a document is toxic if any sentence is.

A sentence's probability is logistic in the words it holds; a document's is the noisy-or of
its sentences. Only document labels are needed: the gradient of the noisy-or shares a
document's label out to its sentences. Weights are fitted on a bounded sample of labelled
documents with follow-the-regularised-leader and an L1 penalty, so few features keep a weight,
and the sentence scores then locate what makes a document toxic. Features are words and their
first three to five characters, which stand for the inflected forms of a stem.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm.common import DOC, TEXT, append_columns, exactly, fold_of, place_of, stored

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
SAMPLE = 18_000  # labelled documents that weights are fitted on
SAMPLE_BYTES = 64 << 20  # and bytes of their texts
SUPPORT = 3  # toxic documents of the sample that must hold a feature
ODDS = 8.0  # how many times likelier it must be in a toxic document than in a clean one
PREFIXES = (3, 4, 5)
KNOWN = 200_000  # words a task remembers
THRESHOLD = 0.7
PRIOR = -6.0  # where the sentence bias starts: nearly all sentences are clean


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n]]


class Weighted(dict):
    """Word to those of its features that have a weight; starts anew when too large."""

    def __init__(self, names):
        super().__init__()
        self.names = names

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= KNOWN:
            self.clear()
        value = self[word] = tuple(f for f in features_of(word) if f in self.names)
        return value


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of features, and the logit of a sentence that has none of them."""

    weights: dict[str, float]
    bias: float

    def sentences(self, text: str, known: Weighted) -> Iterator[tuple[int, int, float]]:
        """(start, end, logit) of the sentences in which a weighted feature occurs."""
        for m in SENTENCE.finditer(text):
            held = {f for w in WORD.findall(m.group().lower()) for f in known[w]}
            if held:
                yield m.start(), m.end(), self.bias + sum(self.weights[f] for f in held)

    def score(self, text: str | None, known: Weighted) -> float:
        """Noisy-or over all sentences of the text; the empty text counts as one sentence."""
        n = len(SENTENCE.findall(text)) if text else 0
        logits = []
        if text and any(map(known.__getitem__, set(WORD.findall(text.lower())))):
            logits = [z for _, _, z in self.sentences(text, known)]
        plain = max(n, 1) - len(logits)
        clean = sum(np.logaddexp(0.0, z) for z in logits) + plain * np.logaddexp(0.0, self.bias)
        return float(-np.expm1(-clean))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int
                    ) -> list[tuple[str, int]]:
    """(text, toxic) of about ``sample`` labelled documents, at most about ``sample_bytes``.

    The labels are counted and sampled by hash before they meet a text, so the side that is
    broadcast has about ``sample`` rows and no text is shuffled; if the texts turn out too long
    or too many, fewer rows are taken. Documents are taken whole. A document that has several
    labels counts with each; null labels and texts teach nothing.
    """
    known = exactly(labels, DOC, "toxic").filter(f"{DOC} is not null and toxic is not null")
    share = sample / max(known.count(), 1)
    some = stored(known.withColumn("place", place_of(DOC)).filter(F.col("place") < share).drop("place"),
                  "sample", 2 * sample)
    texts = exactly(docs, DOC, TEXT).filter(f"{TEXT} is not null").join(F.broadcast(some), DOC)
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length(TEXT))).first()
    if not n:
        return []
    share = min(1.0, 2 * sample / n, sample_bytes / max(size or 1, 1))
    rows = (texts.withColumn("place", place_of(DOC, TEXT)).filter(F.col("place") < share)
            .select(TEXT, F.col("toxic").cast("int")).collect())
    return sorted((r[0], int(r[1] > 0)) for r in rows)


def fit_noisy_or(data: Sequence[tuple[str, int]], visits: int = 60_000, alpha: float = 1.0,
                 beta: float = 1.0, l1: float = 0.2, l2: float = 0.01) -> ToxicityModel:
    """Follow-the-regularised-leader on the log loss of the noisy-or of a document; the sample
    is passed over five times at least, and until about ``visits`` documents were seen."""
    if not data:
        return ToxicityModel({}, PRIOR)
    toxic, clean = Counter(), Counter()
    for text, label in data:
        found = {f for w in set(WORD.findall(text.lower())) for f in features_of(w)}
        (toxic if label else clean).update(found)
    n_toxic = sum(label for _, label in data)
    n_clean = len(data) - n_toxic
    names = sorted(f for f, n in toxic.items() if n >= SUPPORT and
                   (n + 0.5) / (n_toxic + 1) >= ODDS * (clean[f] + 0.5) / (n_clean + 1))
    vocabulary = {f: i for i, f in enumerate(names)}
    v, known = len(vocabulary), Weighted(vocabulary)
    bags = []
    for text, label in data:
        rows, cols, n = [], [], 0
        for m in SENTENCE.finditer(text):
            ids = {vocabulary[f] for w in WORD.findall(m.group().lower()) for f in known[w]}
            rows += [n] * len(ids)
            cols += ids
            n += 1
        bags.append((np.array(rows, np.int32), np.array(cols, np.int32), max(n, 1), label))
    z, g2 = np.zeros(v), np.zeros(v)
    bias, bias2 = PRIOR, 0.0
    order = np.random.default_rng(7)
    for _ in range(max(5, min(60, visits // len(data)))):
        for b in order.permutation(len(bags)):
            rows, cols, n, label = bags[b]
            zc = z[cols]
            w = -np.sign(zc) * np.maximum(np.abs(zc) - l1, 0) / ((beta + np.sqrt(g2[cols])) / alpha + l2)
            logit = bias + np.bincount(rows, w, n)
            spared = np.logaddexp(0.0, logit).sum()  # -log of the probability that all are clean
            p = 1.0 / (1.0 + np.exp(-logit))
            # d loss / d logit of a sentence: p for a clean document, -p (1 - P) / P for a toxic one
            by = p if not label else -p / max(np.expm1(min(spared, 50.0)), 1e-9)
            by = np.clip(by, -1.0, 1.0)
            at, where = np.unique(cols, return_inverse=True)
            g = np.bincount(where, by[rows], len(at))
            wat = np.zeros(len(at))
            wat[where] = w
            z[at] += g - (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / alpha * wat
            g2[at] += g * g
            gb = float(by.sum())
            bias2 += gb * gb
            bias = float(np.clip(bias - 0.2 * gb / (1.0 + np.sqrt(bias2)), -14.0, 0.0))
    w = -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(g2)) / alpha + l2)
    return ToxicityModel({word: float(w[i]) for word, i in vocabulary.items() if abs(w[i]) > 1e-3}, bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE,
                 sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    return fit_noisy_or(labelled_sample(docs, labels, sample, sample_bytes))


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1,
             sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Learns from labels of rows whose crc32(doc_id) modulo ``parts`` is not ``held``; a null
    doc_id counts as remainder 0 and matches no label. Null and empty texts are scored as one
    sentence without words. Without labels every score is near zero. Repeated rows are
    answered alike; other columns are ignored; an empty table gives an empty table.
    """
    fold = fold_of(DOC, parts) == held
    model = fit_toxicity(docs, exactly(labels, DOC, "toxic").filter(~fold), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # no more words than the sample has

    def each():
        model = shared.value
        known = Weighted(model.weights)
        return lambda texts: [pa.array([model.score(t, known) for t in texts], pa.float64())]

    made = append_columns(exactly(docs, DOC, TEXT), TEXT, [("score", "double")], each)
    return made.toDF(DOC, TEXT, "score").select(
        DOC, fold.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def offending_sentences(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score) of the sentences with a probability of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def each():
        known = Weighted(shared.value.weights)

        def locate(texts):
            out = []
            for t in texts:
                found = [(s, e, float(1 / (1 + np.exp(-z)))) for s, e, z in shared.value.sentences(t or "", known)]
                out.append([{"start": s, "end": e, "score": p} for s, e, p in found if p >= least])
            return [pa.array(out, kind)]

        return locate

    made = append_columns(exactly(docs, DOC, TEXT), TEXT,
                          [("spans", "array<struct<start:bigint,end:bigint,score:double>>")], each)
    return made.toDF(DOC, TEXT, "spans").select(DOC, F.explode("spans").alias("s")).select(DOC, "s.*")
