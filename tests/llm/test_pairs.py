"""Near-duplicate, containment and search operators against brute force on small tables."""

import itertools
import random
import time
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from oracle import connect, difference, spark_table, sql_table
from pyspark.sql import functions as F

from descry.llm import contamination, sharding, simhash, substrings, topk
from descry.llm.components import components
from descry.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, TEXT string, fingerprint int, bits int"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def odd_rows():
    return [(900, None, "x", 1, 2), (901, "", "x", 1, 2), (901, "", "x", 1, 2), (902, " \n\t", "x", 1, 2),
            (None, "a b c d", "x", 1, 2), (903, "one", "x", 1, 2), (904, "one", "x", 1, 2)]


def classes(ids, linked):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b) and top(a) != top(b):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in ids}


def plain_fingerprint(text, n=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    shingles = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(4)
    base = words(rng, 150)
    rows = [(i, " ".join(base), "x", 1, 2) for i in range(40)]  # a third of all rows
    for i in range(40, 70):
        near = list(base)
        near[rng.randrange(150)] = f"changed{i}"
        rows.append((i, " ".join(near), "x", 1, 2))
    rows += [(i, " ".join(words(rng, rng.randrange(1, 120))), "x", 1, 2) for i in range(70, 120)]
    return spark.createDataFrame(rows + odd_rows(), SHAPE).repartition(5)


@pytest.mark.parametrize("group", [8, 4096])
def test_simhash_components(copies, group):
    rows = copies.collect()
    fp = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows if r["doc_id"] is not None}
    want = classes(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = simhash.near_duplicates(copies, group=group).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert int(r["fingerprint"], 16) == fp[r["doc_id"]] and len(r["fingerprint"]) == 16
            assert r["component_id"] == want[r["doc_id"]]
    kept = [r["doc_id"] for r in simhash.one_of_each(copies).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(want.values()))
    assert kept.count(None) == 1 and simhash.one_of_each(copies).columns == copies.columns


def test_links_within_finds_all_components():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2 ** 63, 300, dtype=np.uint64))
    near = np.array([fps[i % 40] ^ np.uint64(1 << int(rng.integers(64))) for i in range(200)], np.uint64)
    fps = np.unique(np.concatenate([fps, near]))
    links = {frozenset(p) for p in simhash.links_within(fps, 3)}
    close = lambda a, b: (int(fps[a]) ^ int(fps[b])).bit_count() <= 3
    assert all(close(*p) for p in links)
    assert classes(range(len(fps)), close) == classes(range(len(fps)), lambda a, b: frozenset((a, b)) in links)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}, 7: 7}


def test_passages_are_exactly_the_shared_ones(spark):
    rng = random.Random(9)
    pool = lambda n: words(rng, n, 5000)
    shared, short = pool(60), pool(48)
    rows = [(i, " ".join(pool(rng.randrange(0, 90)) + shared + pool(rng.randrange(0, 90)))) for i in range(30)]
    rows += [(i, " ".join(pool(40) + short + pool(40))) for i in range(30, 40)]
    rows += [(i, " ".join(pool(rng.randrange(1, 300)))) for i in range(40, 60)]
    whole = " ".join(pool(200))
    rows += [(i, whole) for i in range(60, 90)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows] + odd_rows(), SHAPE).repartition(4)
    got = substrings.duplicate_passages(docs).collect()
    text = {i: substrings.words_of(t) for i, t in rows}
    where = defaultdict(set)
    for i, w in text.items():
        for j in range(len(w) - 49):
            where[tuple(w[j:j + 50])].add(i)
    holders = {i for s in where.values() if len(s) > 1 for i in s}
    assert {r["doc_id"] for r in got} == holders
    assert {r["class_id"] for r in got if r["doc_id"] < 30} == {0}
    assert {r["class_id"] for r in got if r["doc_id"] >= 60} == {60}
    for r in got:
        assert r["last_word"] - r["first_word"] + 1 >= 50 and r["similarity"] >= 0.8
        a = set(text[r["doc_id"]][r["first_word"]:r["last_word"] + 1])
        assert len(a & set(text[r["other_id"]])) >= 0.8 * len(a)


def test_edited_passages_are_found(spark):
    rng = random.Random(3)
    passage = words(rng, 120, 9000)
    rows = []
    for i in range(20):
        own = list(passage)
        own[60] = f"edit{i}"
        rows.append((i, " ".join(words(rng, 50, 9000) + own + words(rng, 50, 9000))))
    got = substrings.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(20)) and {r["class_id"] for r in got} == {0}


def plain_segments(x, y, width, share):
    if len(x) < width:
        return []
    runs = []
    for s in range(len(x)):
        for e in range(s + width, len(x) + 1):
            a, b = set(x[s:e].tolist()), set(y[s:e].tolist())
            ends = (x[s] in b or y[s] in a) and (x[e - 1] in b or y[e - 1] in a)
            if ends and len(a & b) / len(a | b) >= share:
                runs.append((e - s, -abs(s + e - len(x)), -s, len(a & b) / len(a | b)))
    if not runs:
        return []
    n, _, s, similarity = max(runs)
    s, e = -s, n - s
    return ([(s, e - 1, similarity)] + plain_segments(x[:s], y[:s], width, share)
            + [(a + e, b + e, c) for a, b, c in plain_segments(x[e:], y[e:], width, share)])


@pytest.mark.parametrize("n, edits, whole", [
    (50, [25], False), (51, [0], True), (60, [30], True), (88, [44], True), (60, [20, 40], False),
    (149, [49, 99], True), (110, [10, 14, 60, 90], False), (120, [55, 56, 57], True)])
def test_edited_passages_are_verified_like_brute_force(n, edits, whole):
    rng = random.Random(n)
    text = [f"u{i}" for i in range(n)]
    other = [f"edit{i}" if i in edits else w for i, w in enumerate(text)]
    known = substrings.WordHashes()
    ids = lambda w: (substrings.shingle_ids(w, known, 5) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    got = sorted(substrings.segments(ids(text), ids(other), 46, 0.8))
    assert got == sorted(plain_segments(ids(text), ids(other), 46, 0.8))
    if whole:
        assert got and sum(e - s + 1 for s, e, _ in got) >= n - 4 - 5
    few = lambda: np.array([rng.randrange(12) for _ in range(50)])  # noqa: E731 repeats, shifted parts
    for _ in range(6):
        x = few()
        y = np.where(np.array([rng.random() < 0.2 for _ in range(50)]), few() + 6, np.roll(x, rng.randrange(3)))
        assert sorted(substrings.segments(x, y, 20, 0.8)) == sorted(plain_segments(x, y, 20, 0.8))


def test_copies_are_found_beside_a_representative_with_a_part(spark):
    rng = random.Random(8)
    pool = lambda n: words(rng, n, 90_000)
    node = lambda i, t: spark.range(1).select(F.xxhash64(F.lit(i).cast("long"), F.lit(t))).first()[0]
    rows, pairs = [], []
    for n in range(0, 60, 3):
        passage = pool(50)
        rows += [(n, " ".join(pool(30) + passage + pool(30))), (n + 1, " ".join(pool(20) + passage + pool(9)))]
        part, at = passage[:45], n + 2  # the part is to be the representative: it has the smallest node
        least = min(node(*r) for r in rows[-2:])
        while node(at, text := " ".join(pool(40) + part + pool(40))) > least:
            pass
        rows.append((at, text))
        pairs.append({n, n + 1})
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [{r["doc_id"], r["other_id"]} for r in substrings.duplicate_passages(docs).collect()]
    assert all(p in got for p in pairs) and all(g in pairs for g in got)


def test_compact_windows_meet_on_every_shared_passage():
    rng = np.random.default_rng(5)
    inner = rng.integers(0, 2 ** 63, 46, dtype=np.uint64)
    for n in range(12):
        left, right = (rng.integers(0, 2 ** 63, int(rng.integers(0, 80)), dtype=np.uint64) for _ in range(2))
        a = substrings.window_keys(np.concatenate([left, inner, right]), 46)
        b = substrings.window_keys(np.concatenate([right, inner, left]), 46)
        assert len(set(a[0]) & set(b[0])) >= 3, n


def test_containment_blocks_and_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SHAPE)
    items = spark.createDataFrame([(1, "A, b; c d"), (2, None), (None, "one"), (3, ""), (4, "one")],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(docs, items).collect()}
    assert got == {(None, 1), (903, 4), (904, 4)}
    assert contamination.contaminated(docs, items, block_bytes=1).count() == 3
    left = contamination.without_leaks(docs, items)
    assert left.columns == docs.columns and left.count() == 4
    assert contamination.contaminated(docs, items.limit(0)).count() == 0
    assert contamination.contaminated(docs.limit(0), items).count() == 0


def test_containment_at_the_threshold(spark):
    item = [f"i{n}" for n in range(29)]  # 25 shingles: 20 are needed
    inside, outside = item[:24], item[:23]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 900 + inside + ["y"] * 900)),
                                  (2, " ".join(["x"] * 9 + outside + ["y"] * 9))], "doc_id long, text string")
    got = contamination.contaminated(docs, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, 5, 20, 25, 0.8)]


def test_top_k_with_ties_copies_and_invalid_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 5])).tolist()) for i in range(400)]
    rows += [(i, [1.0] * 6) for i in range(400, 600)]
    rows += [(50, [1.0] * 6), (51, None), (None, [1.0] * 6), (53, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
             (54, [float("nan")] * 6), (55, [float("inf")] * 6), (100, [3e9] * 6), (100, [1.0, 2.0]), (150, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    valid = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows
             if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for a, (i, e) in enumerate(valid):
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(e, f)), j) for b, (j, f) in enumerate(valid)
                          if b != a and len(f) == len(e))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    got = topk.top_k(vectors, F.col("id") % 50 == 0, block=64, query_block=7)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    assert topk.top_k(vectors.limit(0), F.col("id") % 50 == 0).count() == 0


def broadcast_parts(df):
    """The text of every plan part that is sent to all tasks through the driver."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:below])


def test_top_k_blocks_do_not_pass_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=n).tolist()) for n in (6, 3) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made, plain = [], topk.stored

    def noted(df, name, *more):
        made.append(df)
        return plain(df, name, *more)

    monkeypatch.setattr(topk, "stored", noted)
    got = topk.top_k(vectors, F.col("id") % 50 == 0, block=16, query_block=2)
    parts = [p for df in [*made, got] for p in broadcast_parts(df)]
    assert got.count() == 40 and not [p for p in parts if "payload" in p]


@pytest.mark.parametrize("limit", [20_000, 3_000])
def test_shards_match_sql_at_small_limits(spark, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sql = sharding.SHARDS_SQL.replace(str(sharding.LIMIT), str(limit))
    assert difference(spark_table(sharding.shards(docs, limit)), sql_table(connect(SF), sql)) is None


def test_shards_split_repeated_ids_and_write(spark, tmp_path):
    rows = [(1, "a" * 10, "en")] * 50 + [(None, "hello there", "en")] * 9 + [(2, "", ""), (3, None, None), (4, "b" * 500, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shards(docs, 100).collect()
    size = defaultdict(int)
    for r in got:
        size[r["shard"]] += r["bytes"]
    assert len(got) == len(rows) and sorted(size.values())[-2:] != [500, 500]
    assert all(b <= 100 or b == 500 for b in size.values())
    assert all(size[r["shard"]] == r["shard_bytes"] for r in got)
    assert sharding.shards(docs.limit(0), 100).count() == 0
    sharding.write_shards(docs, str(tmp_path / "s"), 100)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and back.select("_shard").distinct().count() == len(size)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    assert difference(spark_table(QUERIES[name](spark, SF)), sql_table(connect(SF), ORACLES[name])) is None


def test_near_copies_meet_where_their_representative_resembles_neither(spark):
    """All that share a key and are similar enough around it end in one class."""
    rng = np.random.default_rng(21)
    rows = []
    for group in range(30):
        base = [f"w{group}x{i}" for i in range(64)]
        for edits in [1, 1, 2, 2, 2, 3, 3, 3]:
            words = list(base)
            for at in rng.choice(64, edits, replace=False):
                words[at] = f"e{len(rows)}x{at}"
            rows.append((len(rows), " ".join(words)))
    known = substrings.WordHashes()
    ids = [substrings.shingle_ids(substrings.words_of(t), known, 5) for _, t in rows]
    keys = []
    for one in ids:
        key, at, reach = substrings.window_keys(one, 46)
        keys.append({(k, a): (a - r // substrings.EXTENT % substrings.EXTENT, a + r % substrings.EXTENT)
                     for k, a, r in zip(key.tolist(), at.tolist(), reach.tolist())})
    want = set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        for k in keys[i].keys() & keys[j].keys():
            lo, hi = max(keys[i][k][0], keys[j][k][0]), min(keys[i][k][1], keys[j][k][1])
            if substrings.segments(ids[i][lo:hi + 1], ids[j][lo:hi + 1], 46, 0.8):
                want.add((i, j))
    got = substrings.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = {r["doc_id"]: r["class_id"] for r in got}
    assert len(want) > 30
    lost = [p for p in want if p[0] not in classes or classes[p[0]] != classes.get(p[1])]
    assert not lost


def test_members_that_share_too_little_never_become_rows(spark, monkeypatch):
    """Unlike texts with one common line meet under its keys in blocks, not as pairs of rows."""
    rng = random.Random(5)
    pool = lambda n: words(rng, n, 90_000)
    line, near = pool(38), pool(60)
    rows = [(i, " ".join(pool(40) + line + pool(40))) for i in range(160)]
    rows += [(i, " ".join(near[:at] + [f"edit{i}"] + near[at + 1:])) for i, at in ((160, 30), (161, 30))]
    made, plain = {}, substrings.stored

    def counted(df, name, *more):
        out = plain(df, name, *more)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(substrings, "stored", counted)
    got = substrings.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(160, 160), (161, 160)}
    assert made["members"] > len(rows)
    assert made["crossed"] + made.get("apart", 0) <= len(rows)


def test_near_copies_of_one_class_are_listed_too(spark):
    """Two texts that share an exact passage share a near copy as well, whose representative resembles neither."""
    rng = np.random.default_rng(23)
    pool = random.Random(2)
    rows = []
    for group in range(24):
        base = [f"w{group}x{i}" for i in range(64)]
        shared = words(pool, 60, 10 ** 9)
        for edits in [1, 1, 2, 2, 2, 3, 3, 3]:
            near = list(base)
            for at in rng.choice(64, edits, replace=False):
                near[at] = f"e{len(rows)}x{at}"
            rows.append((len(rows), " ".join(shared + words(pool, 60, 10 ** 9) + near)))
    known = substrings.WordHashes()
    ids = [substrings.shingle_ids(substrings.words_of(t), known, 5) for _, t in rows]
    keys = []
    for one in ids:
        key, at, reach = substrings.window_keys(one, 46)
        keys.append({(k, a): (a - r // substrings.EXTENT % substrings.EXTENT, a + r % substrings.EXTENT)
                     for k, a, r in zip(key.tolist(), at.tolist(), reach.tolist()) if a > 120})
    want = set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        for k in keys[i].keys() & keys[j].keys():
            lo, hi = max(keys[i][k][0], keys[j][k][0], 120), min(keys[i][k][1], keys[j][k][1])
            if substrings.segments(ids[i][lo:hi + 1], ids[j][lo:hi + 1], 46, 0.8):
                want |= {i, j}
    got = substrings.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: i // 8 * 8 for i in range(len(rows))}
    near = {r["doc_id"] for r in got if r["last_word"] >= 160}
    assert len(want) > 30 and want <= near


def test_members_meet_across_blocks(spark, monkeypatch):
    """Blocks of three members give the classes that one block gives."""
    rng = random.Random(6)
    base = words(rng, 64, 90_000)
    rows = []
    for i in range(40):
        own = list(base)
        for at in rng.sample(range(64), rng.choice([1, 2, 3])):
            own[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = lambda: {(r["doc_id"], r["class_id"]) for r in substrings.duplicate_passages(docs).collect()}
    whole = classes()
    monkeypatch.setattr(substrings, "BLOCK", 3)
    assert whole and classes() == whole


@pytest.mark.parametrize("pool", [12, 10 ** 9])
def test_no_pair_that_can_pass_is_left_out(pool):
    rng = np.random.default_rng(pool % 97)
    for _ in range(60):
        base = rng.integers(0, pool, 60).astype(np.int32)
        rows = []
        for _ in range(int(rng.integers(2, 12))):
            own = base.copy()
            for at in rng.integers(0, 60, int(rng.integers(0, 5))):
                own[at:at + 5] = rng.integers(0, pool, len(own[at:at + 5]))
            rows.append(own[:60 - int(rng.integers(0, 10))])
        label = rng.integers(0, 4, len(rows))
        for left in (None, 1):
            got = set(zip(*[v.tolist() for v in substrings.alike(rows, label, left, 20, 0.8)], strict=True))
            assert all(label[i] != label[j] and (left is None or i < left <= j) for i, j in got)
            for i, j in itertools.combinations(range(len(rows)), 2):
                n = min(len(rows[i]), len(rows[j]))
                if label[i] != label[j] and (left is None or i < left <= j):
                    assert (i, j) in got or not substrings.segments(rows[i][:n], rows[j][:n], 20, 0.8)


def test_stored_leaves_no_shuffle_files(spark):
    from descry.llm.common import stored

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {f for f in (found.apply(i).getName() for i in range(found.size())) if "shuffle_" in f}

    before, told = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    out = stored(spark.range(20_000).repartition(7, "id").selectExpr("id % 100 k").groupBy("k").count(), "cleaned")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == told
