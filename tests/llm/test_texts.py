"""Operators on single texts: round trips, brute force and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from descry.llm import language, packing, pii, simhash, tokenfiles, toxicity
from descry.llm.common import fold_of
from descry.llm.encoding import Encoder, packed, tokenizer_path
from descry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "en", 1), (2, "", "en", 1), (None, "hello there", "en", 1), (2, "", "en", 1), (3, "9" * 5000, None, 1)]
SHAPE = "doc_id long, text string, lang string, score int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SHAPE)


@pytest.mark.parametrize("name,byte_level", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunks_encode_like_the_whole_text(name, byte_level):
    rng = random.Random(3)
    parts = ["a", "Foo", "é", "é", "ß", "'s", "don't", " ", "  ", "\n", "\t", " ", "\x1c", ".", ",", "42",
             "Σ", "İ", "ñ", "##", "%%%", "😀", "<|endoftext|>", "word", "×", "|", "-",
             "<|startoftext|>", "<|ENDOFTEXT|>", "<|"]
    known = Encoder(tokenizer_path(name), byte_level, known=50)
    as_text = Encoder(tokenizer_path(name), byte_level, known=50, special_as_text=True)
    plain = Tokenizer.from_file(tokenizer_path(name))  # untouched: the contract's plain call
    literal = Tokenizer.from_file(tokenizer_path(name))
    literal.encode_special_tokens = True
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert known.ids(text) == packed(plain.encode(text, add_special_tokens=False).ids), text
        assert as_text.ids(text) == packed(literal.encode(text, add_special_tokens=False).ids), text


def whole_ids(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_round_trip(spark, docs, tmp_path):
    folder = str(tmp_path / "t")
    tokenfiles.write_token_files(docs, folder, block_bytes=1 << 14)
    texts, at = {r["doc_id"]: r["text"] for r in docs.collect()}, 0
    for r in sorted(tokenfiles.read_token_files(spark, folder).collect()):
        ids = whole_ids("word_bpe_49k.json", texts[r["doc_id"]], 1)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    some = sorted(texts)[7]
    assert (tokenfiles.read_document(spark, folder, some)[0] == whole_ids("word_bpe_49k.json", texts[some], 1)).all()
    assert tokenfiles.codec_of(spark, folder).dictionary


def test_token_files_of_odd_rows(spark, odd):
    got = sorted(tokenfiles.round_trip(odd).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2, 3] and got[1]["n_tokens"] == 1
    assert tokenfiles.round_trip(odd.limit(0)).count() == 0


def check_packing(rows, ids, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, own in ids.items():
        at = 0
        for i, r in enumerate(sorted(by_doc[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at) and (i == 0 or r["length"] == size)
            assert zlib.crc32(own[at:at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(own) and (len(own) > size or len(by_doc[doc]) == 1)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence)


def test_packing_is_whole_and_tight(docs):
    ids = {r["doc_id"]: whole_ids("byte_bpe_50k.json", r["text"], 2) for r in docs.collect()}
    used = check_packing(packing.pack(docs).collect(), ids, 1024)
    lower = -(-sum(map(len, ids.values())) // 1024)
    assert lower <= used <= 1.02 * lower + 1


def test_packing_of_odd_rows(odd):
    got = packing.pack(odd).collect()
    assert sum(r["doc_id"] is None for r in got) == 1 and sum(r["doc_id"] == 2 for r in got) == 2
    assert packing.pack(odd.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_beats_or_meets_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 1025, 20000), rng.integers(335, 520, 20000), rng.integers(1, 40, 5000),
               rng.integers(500, 530, 3000)][seed]
    counts = np.bincount(lengths, minlength=1025)
    plan = packing.plan(counts)
    held = np.zeros(1025, np.int64)
    for line in plan:
        assert sum(line.lengths) <= 1024
        np.add.at(held, line.lengths, line.count)
    assert (held == counts).all()
    used = sum(line.count for line in plan)
    assert -(-int(lengths.sum()) // 1024) <= used <= sum(x.count for x in packing.best_fit([], counts, 1024))


def test_grouped_plan_covers_every_piece():
    counts = np.bincount(np.random.default_rng(1).integers(200, 700, 5000), minlength=1025)
    held = np.zeros(1025, np.int64)
    for line in packing.grouped_plan(counts, 1024, 12, 16):
        np.add.at(held, line.lengths, line.count)
    assert (held == counts).all()


#: The base patterns of the four kinds.
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), i, m.end(), k) for i, k in enumerate(BASE) for m in re.finditer(BASE[k], text or "")
             if valid(k, m.group())]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_personal_data_against_plain_patterns(spark, docs):
    rng = random.Random(5)
    parts = ["1", "2", "25", "255", "256", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "+1", "é",
             "4111 1111 1111 1111", "x@y.z", "😀", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, "1" * 20000), (2003, "a" * 30000), (2004, "a.b@" * 9000),
             (2005, "1.2.3.4 " * 2000), (2006, "a@b.c+d@e.f"), (2007, "00000000000001.02.3.0004")]
    hard = spark.createDataFrame(rows, "doc_id long, text string")
    for table in (docs, hard):
        texts = {r["doc_id"]: r["text"] for r in table.collect()}
        masked = {r["doc_id"]: r["text"] for r in pii.redacted(table).collect()}
        for r in pii.personal_data(table).collect():
            want = base_spans(texts[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in want) for k in BASE]
            spans = [s.split(":") for s in r["spans"].split(",") if s]
            assert [":".join(s) for s in spans if s[0] != "id"] == want
            out, at = "", 0
            for kind, start, end in spans:
                if int(start) >= at:
                    out += texts[r["doc_id"]][at:int(start)] + f"<{kind}>"
                at = max(at, int(end))
            if spans:
                assert masked[r["doc_id"]] == out + texts[r["doc_id"]][at:]
            else:
                assert masked[r["doc_id"]] == texts[r["doc_id"]]


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"some words then reach me mail{i}@example.com and more") for i in range(12)]
    rows += [(20, "again reach me user#4711 please"), (21, "we saw number 4711abc here"), (22, "reach me now")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == "id:15:24" and got[21] == "" and got[22] == "" and got[0].startswith("email:")


def discovered_ids(spark, lines):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {lines[r["doc_id"]] for r in pii.personal_data(docs).collect() if "id:" in r["spans"]}


def test_discovered_identifiers_induce_patterns(spark):
    handles = [f"user#{i}471" for i in range(6)]
    lines = [f"then reach me mail{i}@example.com" for i in range(24)] + [f"then reach me {h}" for h in handles]
    lines += [f"the handle is {h}" for h in handles] + ["the handle is other#99", "the order was 4711abc"]
    assert discovered_ids(spark, lines) == {x for x in lines if "#" in x}


@pytest.mark.parametrize("seeds", [9, 10, 15])
def test_a_pattern_does_not_feed_its_own_trust(spark, seeds):
    lines = [f"then reach me mail{i}@example.com" for i in range(seeds)]
    assert discovered_ids(spark, lines + [f"then reach me order{i}" for i in range(20 - seeds)]) == set()


def test_personal_data_of_odd_rows(odd):
    got = pii.personal_data(odd).collect()
    assert len(got) == len(ODD) and all(r["spans"] == "" for r in got)
    assert pii.redacted(odd).columns == odd.columns and pii.redacted(odd).count() == len(ODD)
    assert pii.personal_data(odd.limit(0)).count() == 0


def test_language_of_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in table.collect()}
    rows = [r for r in language.identify(table).collect() if r["held_out"]]
    assert len(rows) > 150
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(odd):
    got = language.identify(odd).collect()
    assert sorted(r["lang_pred"] for r in got) == ["en", "und", "und", "und", "und"]
    assert language.identify(odd.limit(0)).count() == 0
    kept = language.in_a_language(odd)
    assert kept.columns == odd.columns and [r["text"] for r in kept.collect()] == ["hello there"]


def test_language_ignores_held_out_labels(spark, docs):
    wrong = docs.withColumn("lang", __import__("pyspark").sql.functions.when(fold_of("doc_id", 4) == 2, "zz").otherwise(docs.lang))
    assert sorted(language.identify(docs).collect()) == sorted(language.identify(wrong).collect())


def test_calibration_and_pieces_of_long_texts():
    logits = np.array([[9.0, 0.0], [0.0, 9.0]] * 40 + [[9.0, 0.0]] * 20)
    assert language.calibrated(logits, np.array([0, 1] * 40 + [1] * 20)) > 3
    text = "abcde " * (language.STEP // 3)
    at, n = language.gram_counts(text)
    assert n.sum() == 3 * len(text) - 3


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    table, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity.toxicity(table, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    score = np.array([r["score"] for r in rows])
    label = np.array([truth[r["doc_id"]] for r in rows])
    rank = score.argsort().argsort()
    auc = (rank[label == 1].mean() - (label.sum() - 1) / 2) / (label == 0).sum()
    assert auc > 0.93 and (score[label == 0] >= 0.7).mean() < 0.02


def test_toxic_sentences_are_located(spark):
    rng = random.Random(1)
    clean = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(8)) + "."
    data = []
    for i in range(600):
        sentences = [clean() for _ in range(6)]
        if i % 3 == 0:
            sentences[i % 6] = "you total nasty%s person." % rng.choice(["", "ly", "ness"])
        data.append((" ".join(sentences), int(i % 3 == 0)))
    model = toxicity.fit_noisy_or(data)
    known = toxicity.Weighted(model.weights)
    assert all((model.score(t, known) >= 0.7) == bool(y) for t, y in data)
    docs = spark.createDataFrame([(1, data[0][0]), (2, data[1][0]), (3, None)], "doc_id long, text string")
    found = toxicity.offending_sentences(docs, model).collect()
    assert {r["doc_id"] for r in found} == {1}
    assert all("nasty" in data[0][0][r["start"]:r["end"]] for r in found)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    assert toxicity.toxicity(odd.limit(0), labels.limit(0)).count() == 0


def test_pipeline_stages(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "decontamination", "personal_data", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns
        left = {r["doc_id"]: r for r in after.collect()}
        before = {r["doc_id"]: r for r in now.collect()}
        if name == "language_id":
            assert set(before) - set(left) == {i for i, r in before.items() if not re.search(r"[^\W\d_]", r["text"] or "")}
        if name == "simhash_near_dedup":
            classes = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(now).collect()}
            assert set(left) == set(classes.values())
        if name == "decontamination":
            leaks = {r["doc_id"] for r in QUERIES["op4_benchmark_decontamination"](spark, SF).collect()}
            assert set(left) == set(before) - leaks
        if name == "personal_data":
            assert set(left) == set(before)
            assert all(not base_spans(r["text"]) or base_spans(before[i]["text"]) for i, r in left.items())
            assert any(r["text"] != before[i]["text"] for i, r in left.items())
        now = spark.createDataFrame(list(left.values()), docs.schema)
    rows = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    check_packing(rows, {r["doc_id"]: whole_ids("byte_bpe_50k.json", r["text"], 2) for r in now.collect()}, 1024)
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()} == {
        (r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows}
