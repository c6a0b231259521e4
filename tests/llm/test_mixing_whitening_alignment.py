"""Source mixing, embedding whitening and tokenizer alignment against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from descry.llm import alignment, mixing, whitening
from descry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, TEXT string"


# --- mixing -------------------------------------------------------------------------------

def plain_targets(sizes: dict, weights=(5, 2, 1), cap=3):
    """The contract read literally: share by weight, stop at cap, reshare until none is above."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped, target = sum(sizes.values()), {}, {}
    while True:
        left = total - sum(cap * sizes[s] for s in stopped)
        share = sum(weight[s] for s in names if s not in stopped)
        target = {s: cap * sizes[s] if s in stopped else weight[s] * left / share for s in names}
        over = [s for s in names if s not in stopped and target[s] > cap * sizes[s]]
        if not over:
            return target
        stopped.update(dict.fromkeys(over))


def check_mix(rows, out):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += size(text)
    want = plain_targets(dict(sizes))
    got = out.toPandas()
    assert len(got) == len(rows)
    assert sorted(got["size"]) == sorted(size(r[1]) for r in rows)
    assert (got["taken"] <= 3 * got["size"]).all()
    assert (got["taken"] == got["copies"] * got["size"]).all()
    for source, part in got.groupby(got["source"].fillna("\0null"), dropna=False):
        key = None if source == "\0null" else source
        assert part["target"].iloc[0] == pytest.approx(want[key], rel=1e-12, abs=1e-9)
        assert (part["source_size"] == sizes[key]).all()
        rate = want[key] / sizes[key] if sizes[key] else 0.0
        assert set(part["copies"]) <= {math.floor(rate + 1e-9), math.ceil(rate - 1e-9)}
        assert abs(part["taken"].sum() - want[key]) <= max(part["size"].max(), 1)
    return got


def test_mixing_against_plain_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source, None) for r in docs.select("doc_id", "text", "source").collect()]
    first = check_mix(rows, mixing.mix(docs))
    again = mixing.mix(docs).toPandas()
    key = ["doc_id", "taken"]
    assert first.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()


def test_mixing_of_odd_rows(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, "one two", None, "x"), (3, "one two", None, "x"),
            (None, "w " * 30000, "b", "x"), (4, "\t\n x \x0b y\x0c", "b", "y"), (5, "only", "c", None),
            (6, "a b c d e f", "a", None)] + [(10 + i, "w " * (i % 7 + 1), "c", "z") for i in range(50)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS))
    got = check_mix(rows, out)
    assert got[got["doc_id"] == 3]["taken"].nunique() == 1
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_a_source_without_words_gives_its_share_away(spark):
    rows = [(1, None, "a", None), (2, "x y z", "b", None), (3, "x", "c", None)]
    got = check_mix(rows, mixing.mix(spark.createDataFrame(rows, DOCS))).set_index("doc_id")
    assert got.loc[1, "target"] == 0 and got.loc[1, "taken"] == 0
    assert got["target"].sum() == pytest.approx(4)


# --- whitening ----------------------------------------------------------------------------

def plain_whitening(rows):
    whole = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in whole], dtype=np.float64)) + 100000
    n = len(x)
    mean = x.mean(0)
    cov = (x - mean).T @ (x - mean) / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    s = x.sum(0).astype(np.int64)
    dev = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))) for row in x]
    return [i for i, _ in whole], (x - mean) @ vec[:, :8] / np.sqrt(e[:8]), e[:8] / np.trace(cov), dev


def test_whitening_against_eigh(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, [float(c) for c in r.embedding] if r.embedding is not None else None, 0)
            for r in table.collect()]
    rows += [(-1, None, 0), (-2, [float("nan")] * len(rows[0][1]), 0), (-3, [None] * len(rows[0][1]), 0),
             (-4, [float("inf")] + rows[0][1][1:], 0), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit(1))
    out = whitening.whiten(df).toPandas()
    ids, white, explained, dev = plain_whitening([(i, None if v is None else list(np.float32(v)), 0) for i, v, _ in rows])
    assert len(out) == len(ids) * 8
    assert out["identity_error"].max() <= 1e-4
    by = out.sort_values(["component"]).groupby("component")
    assert np.allclose(by["explained"].first().to_numpy(), explained, rtol=1e-4)
    order = {v: k for k, v in enumerate(ids)}
    got = np.zeros((len(ids), 8))
    devs = {}
    for r in out.itertuples():
        rows_of = [k for k, i in enumerate(ids) if i == r.vec_id]
        for k in rows_of:
            got[k, r.component - 1] = r.whitened
        devs[r.vec_id] = r.deviation
    sign = np.sign((got * white).sum(0))
    assert np.abs(got - white * sign).max() < 1e-6
    assert all(devs[i] == d for i, d in zip(ids, dev))
    assert set(order) == set(out["vec_id"])


def test_whitening_of_empty_and_tiny_tables(spark):
    shape = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], shape)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], shape)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], shape))
    assert same.count() == 0  # constant rows have no component
    two = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.0]), (2, [-0.5, 0.0])], shape)).toPandas()
    assert sorted(two["whitened"].abs()) == pytest.approx([1.0, 1.0]) and (two["component"] == 1).all()


# --- alignment ----------------------------------------------------------------------------

def spans(lengths):
    out, at = [], 0
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


def plain_alignment(rows):
    tok = alignment.tokenizers(*[alignment.tokenizer_path(f) for f in (alignment.A_FILE, alignment.B_FILE)])
    per, links_of = [], []
    for doc_id, text, _, _ in rows:
        a_ids = tok.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b_ids = tok.b.encode(text or "")
        whole = (" " + (text or "")).encode()
        a_sp, b_sp = spans(len(tok.a_bytes[i]) for i in a_ids), spans(len(tok.b_bytes[i]) for i in b_ids)
        if (not text or b"".join(tok.a_bytes[i] for i in a_ids) != whole
                or b"".join(tok.b_bytes[i] for i in b_ids) != whole):
            per.append((doc_id, 0, 0, 0, 0, ""))
            links_of.append([])
            continue
        ends = sorted({e for _, e in a_sp} & {e for _, e in b_sp})
        groups, start = [], 0
        for e in ends:
            ga = [str(i) for i, (s, t) in zip(a_ids, a_sp) if start <= s and t <= e]
            gb = [str(i) for i, (s, t) in zip(b_ids, b_sp) if start <= s and t <= e]
            groups.append(",".join(ga) + "|" + ",".join(gb))
            start = e
        links = [(a, b) for a, (s, t) in zip(a_ids, a_sp) for b, (u, v) in zip(b_ids, b_sp) if s < v and u < t]
        per.append((doc_id, len(a_ids), len(b_ids), len(ends), len(links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links_of.append(links)
    count = Counter(link for links in links_of for link in links)
    best = Counter()
    for (a, b), c in count.items():
        best[b] = max(best[b], c)
    return [(*p, sum(best[b] == count[(a, b)] for a, b in links), sum(count[link] for link in links))
            for p, links in zip(per, links_of)]


def test_alignment_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").limit(60)
    rows = [(r.doc_id, r.text, None, None) for r in docs.collect()]
    rows += [(1, None, "s", "x"), (2, "", "s", "x"), (3, "a <|endoftext|> b </s> <s> <unk>", "s", "x"),
             (3, "a <|endoftext|> b </s> <s> <unk>", "s", "x"), (None, "tab\there  two  spaces", None, None),
             (4, "日本語 テキスト émigré", None, None), (5, "word " * 3000, None, None),
             (6, "a \u2581 b reads back as a space", None, None)]
    out = alignment.alignment(spark.createDataFrame(rows, DOCS))
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum)
           for r in out.collect()]
    key = lambda t: (t[0] is None, t[0] or 0, t[1:])
    assert sorted(got, key=key) == sorted(plain_alignment(rows), key=key)


def test_alignment_of_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], DOCS)).count() == 0


def test_queries_are_registered():
    for name in ("op11_source_mixing", "op12_embedding_whitening", "op13_tokenizer_alignment"):
        assert name in QUERIES
