import numpy as np
import pytest

from descry.operators import similarity, spanning
from descry.operators.blocks import Matrix

NAMES = tuple(f"x{i}" for i in range(4))
SCHEMA = "id long, y double, features array<double>"


def rows_of(x, y):
    return [(i, float(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y))]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows are one vector; one row is zero."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 4))
    x[::3] = [1.0, 2.0, 0.5, -1.0]
    x[149] = 0.0
    y = rng.integers(1, 6, 150).astype(float)
    y[::3] = 3.0
    m = Matrix(spark.createDataFrame(rows_of(x, y), SCHEMA).repartition(5), NAMES)
    return x, y, m


def cosines(x):
    with np.errstate(invalid="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        return u @ u.T


@pytest.mark.parametrize("options", [{}, {"rows_per_block": 7, "pivots": 5}, {"rows_per_block": 3}])
@pytest.mark.parametrize("bound", [0.9, 0.0, -0.5])
def test_cosine_pairs(skewed, options, bound):
    x, _, m = skewed
    reps = [i for i in range(149) if i % 3 or i == 0]
    c = cosines(x)
    want = {(i, j): c[i, j] for i in reps for j in reps if i < j and c[i, j] >= bound}
    got = similarity.cosine_pairs(m, bound, **options).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["cosine"] == pytest.approx(want[r["src"], r["dst"]], abs=1e-12)
        assert r["n_src"] == (50 if r["src"] == 0 else 1)
    copies = {r["id"]: r["rep"] for r in similarity.copies_of(m).collect()}
    assert len(copies) == 150 and copies[3] == 0 and copies[4] == 4


def test_hot_cell_is_cut(spark):
    """Nearly equal directions fall in one cell, which is split in blocks."""
    rng = np.random.default_rng(1)
    x = np.ones((120, 4)) + 1e-3 * rng.normal(size=(120, 4))
    m = Matrix(spark.createDataFrame(rows_of(x, np.ones(120)), SCHEMA), NAMES)
    got = similarity.cosine_pairs(m, 0.999999, rows_per_block=8, pivots=3)
    c = cosines(x)
    assert {(r["src"], r["dst"]) for r in got.collect()} == {
        (i, j) for i in range(120) for j in range(i + 1, 120) if c[i, j] >= 0.999999}


def measures(x, y):
    c = cosines(x)
    r = 1 - np.abs(y[:, None] - y) / (y[:, None] + y)
    return c, r, c * r, 1 - np.abs(c - r) / (c + r)


@pytest.mark.parametrize("size", [2048, 20])
def test_anomaly_degree_with_copies(skewed, size):
    x, y, m = skewed
    overall = measures(x, y)[3]
    with np.errstate(invalid="ignore"):
        want = (overall <= 0.5).sum(axis=1)
    got = {r["id"]: r["degree"] for r in similarity.anomaly_degree(m, rows_per_block=size).collect()}
    assert got == {i: w for i, w in enumerate(want)}


def test_closeness(skewed):
    x, y, m = skewed
    c, r, _, _ = measures(x, y)
    got = {v["id"]: v["closeness"] for v in similarity.closeness(m).collect()}
    assert got[149] is None
    want = 1 / np.nansum(1 - c[:149, :149], axis=1)
    assert [got[i] for i in range(149)] == pytest.approx(list(want), rel=1e-9)
    got = {v["id"]: v["closeness"] for v in similarity.closeness(m, "ratio", rows_per_block=30).collect()}
    assert [got[i] for i in range(150)] == pytest.approx(list(1 / (1 - r).sum(axis=1)), rel=1e-9)


def test_measures_and_edges_of_their_domains(spark):
    pairs = spark.createDataFrame([(0.5, 1.0, 3.0), (0.5, 1.0, -1.0), (0.2, 3.0, 1.0), (-0.5, 1.0, 3.0)],
                                  "cosine double, y_src double, y_dst double")
    got = similarity.with_measures(pairs).collect()
    assert got[0]["ratio"] == 0.5 and got[0]["overall"] == 1.0 and got[0]["interaction"] == 0.25
    assert got[1]["ratio"] is None and got[1]["overall"] is None
    assert got[3]["overall"] is None
    half = spark.createDataFrame([(0.5,), (0.5000001,)], "o double")
    flags = [r[0] for r in half.select(similarity.anomaly_flag(half["o"])).collect()]
    assert flags == [1, 0]


def test_nearest(skewed):
    x, _, m = skewed
    c = cosines(x)
    got = similarity.nearest_to(m, 1, 5).collect()
    want = sorted((i for i in range(149) if i != 1), key=lambda i: (-round(c[1, i], 12), i))[:5]
    assert [r["id"] for r in got] == want
    with pytest.raises(ValueError, match="zero"):
        similarity.nearest_to(m, 149, 5)


@pytest.mark.parametrize("bound", [0.5, 0.9, 0.999])
def test_ratio_levels(spark, bound):
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.exponential(10, 80), np.full(40, 7.5)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id long, y double")
    got = {(r["y_low"], r["y_high"]): r["n_pairs"] for r in similarity.ratio_levels(df, bound).collect()}
    want = {}
    for i in range(120):
        for j in range(i + 1, 120):
            a, b = sorted((float(y[i]), float(y[j])))
            if 1 - (b - a) / (a + b) >= bound:
                want[a, b] = want.get((a, b), 0) + 1
    assert got == want
    with pytest.raises(ValueError, match="positive"):
        similarity.ratio_levels(df.selectExpr("id", "-y as y"), bound)


def kruskal(n, edges):
    leader = list(range(n))

    def find(v):
        while leader[v] != v:
            v = leader[v]
        return v

    out = set()
    for w, a, b in sorted(edges):
        p, q = find(a), find(b)
        if p != q:
            leader[p] = q
            out.add((a, b))
    return out


@pytest.mark.parametrize("measure", range(4))
@pytest.mark.parametrize("most", ["similar", "different"])
def test_spanning_trees(spark, measure, most):
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(60, 4)))
    y = rng.uniform(1, 9, 60)
    m = Matrix(spark.createDataFrame(rows_of(x, y), SCHEMA), NAMES)
    s = measures(x, y)[measure]
    w = 100 * (1 - s) if most == "similar" else 100 * s
    want = kruskal(60, [(w[i, j], i, j) for i in range(60) for j in range(i + 1, 60)])
    name = ("cosine", "ratio", "interaction", "overall")[measure]
    got = spanning.spanning_tree(m, name, most, rows_per_block=16).collect()
    assert {(r["src"], r["dst"]) for r in got} == want and len(got) == 59
    assert all(r["whole"] == int(r["weight"]) for r in got)


@pytest.mark.parametrize("small", [0, 3, 10**6])
def test_forest_rounds(spark, small):
    # the four-node example: its tree has edges 0-3, 1-2 and 1-3
    edges = [(0, 1, 8.0), (0, 3, 3.0), (1, 2, 2.0), (1, 3, 5.0), (2, 3, 6.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    assert {tuple(r) for r in spanning.forest(df, small).collect()} == {(0, 3, 3.0), (1, 2, 2.0), (1, 3, 5.0)}
    rng = np.random.default_rng(6)
    ties = [(int(a), int(b), float(rng.integers(1, 4))) for a in range(30) for b in range(a + 1, 30)
            if (a < 15) == (b < 15) and rng.random() < 0.4]
    df = spark.createDataFrame(ties, "src long, dst long, weight double")
    want = kruskal(30, [(w, a, b) for a, b, w in ties])
    assert {(r["src"], r["dst"]) for r in spanning.forest(df, small).collect()} == want
    assert spanning.forest(df.limit(0), small).count() == 0


def test_copies_are_joined_through_others(spark):
    x = np.array([[1.0, 0, 0, 0], [1.0, 0, 0, 0], [0.5, 1, 0, 0]])
    m = Matrix(spark.createDataFrame(rows_of(x, np.ones(3)), SCHEMA), NAMES)
    got = {(r["src"], r["dst"]) for r in spanning.spanning_tree(m).collect()}
    assert got == {(0, 2), (1, 2)}  # weight zero is no edge


def test_tree_rows_are_the_ends(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)], "id long, a double, b double")
    tree = spark.createDataFrame([(0, 3, 1.0)], "src long, dst long, weight double")
    got = spanning.tree_rows(df, tree, 2)
    assert got.columns == ["id", "a"] and {r["id"] for r in got.collect()} == {0, 3}


@pytest.fixture(scope="module")
def long_block(spark):
    """More rows than are compared at once, in one block or in two."""
    rng = np.random.default_rng(8)
    x, y = np.abs(rng.normal(size=(1100, 4))), rng.integers(1, 9, 1100).astype(float)
    return x, y, Matrix(spark.createDataFrame(rows_of(x, y), SCHEMA), NAMES)


@pytest.mark.parametrize("size", [4096, 600])
def test_pairs_and_sums_of_long_blocks(long_block, size):
    x, y, m = long_block
    c, _, _, overall = measures(x, y)
    got = {r["id"]: r["degree"] for r in similarity.anomaly_degree(m, rows_per_block=size).collect()}
    assert got == dict(enumerate((overall <= 0.5).sum(axis=1)))
    pairs = similarity.cosine_pairs(m, 0.99, with_target=True, rows_per_block=size).collect()
    assert {(r["src"], r["dst"]) for r in pairs} == {tuple(p) for p in np.argwhere(np.triu(c >= 0.99, 1))}
    assert all((r["y_src"], r["y_dst"]) == (y[r["src"]], y[r["dst"]]) for r in pairs)


def test_rows_meet_without_a_shuffle_for_each_block(skewed):
    _, _, m = skewed
    plan = similarity.cosine_pairs(m, 0.5, rows_per_block=5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    blocks = similarity.hashed_blocks(m.df, 150, 1, 4, ["y"])
    got = [i for r in blocks.collect() for i in r["ids"]]
    assert sorted(got) == list(range(150))  # every row once, however many blocks it meets
    assert blocks.count() <= similarity.MOST_BLOCKS


def test_a_block_keeps_one_tree(long_block):
    x, y, m = long_block
    overall = measures(x, y)[3]
    edges = spanning.block_trees(m, "overall", "similar").collect()
    w = 100 * (1 - overall)
    upper = np.argwhere(np.triu(w, 1) > spanning.ZERO)
    want = kruskal(1100, [(w[i, j], int(i), int(j)) for i, j in upper])
    assert {(r["src"], r["dst"]) for r in edges} == want and len(edges) == 1099


def test_forest_joins_do_not_broadcast(spark):
    edges = spark.createDataFrame([(0, 1)], "cs long, cd long")
    plan = spanning._spread(edges, edges.toDF("cs", "rs"), "cs")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.fixture(scope="module")
def copied(spark):
    """Vectors that several ids have, one of them a zero row, one id twice, rows without id, target or vector."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 4))
    x[::4] = x[0]
    x[39] = 0.0
    y = rng.integers(1, 6, 40).astype(float)
    odd = [rows_of(x, y)[1], (50, None, [1.0] * 4), (None, 2.0, [1.0] * 4), (51, 2.0, None)]
    return x, y, Matrix(spark.createDataFrame(rows_of(x, y) + odd, SCHEMA).repartition(5), NAMES)


@pytest.mark.parametrize("options", [{}, {"rows_per_block": 7, "pivots": 5}])
def test_every_copy_is_in_pairs(copied, options):
    x, _, m = copied
    x = np.vstack([x, np.zeros((10, 4)), np.ones((1, 4))])  # 50 has no target, which cosines do not need
    with np.errstate(invalid="ignore"):
        c = cosines(x)
        want = {(i, j) for i in range(51) for j in range(i + 1, 51) if c[i, j] >= 0.3}
    assert (0, 4) in want and (4, 8) in want
    got = similarity.cosine_pairs(m, 0.3, rows=similarity.every_row(m), **options).collect()
    assert {(r["src"], r["dst"]) for r in got} == want and len(got) == len(want)
    copies = {**dict.fromkeys(range(0, 40, 4), 10), 1: 2, 50: 2}
    assert all((r["n_src"], r["n_dst"]) == (copies.get(r["src"], 1), copies.get(r["dst"], 1)) for r in got)


@pytest.mark.parametrize("size", [4096, 7])
def test_anomalies_of_all_pairs(copied, size):
    x, y, m = copied
    overall = measures(x, y)[3]
    want = {(i, j): int(overall[i, j] <= 0.5) for i in range(39) for j in range(i + 1, 39)}
    got = similarity.anomaly_pairs(m, rows_per_block=size).collect()
    assert {(r["src"], r["dst"]): r["anomaly"] for r in got} == want and len(got) == len(want)
    c = cosines(x)
    assert [p for p, flag in want.items() if flag and c[p] < 0.3] and (0, 4) in want


def test_undefined_anomalies_are_null(spark):
    rows = [(0, 1.0, [1.0, 0.0, 0.0, 0.0]), (1, -1.0, [1.0, 1.0, 0.0, 0.0]), (2, 1.0, [1.0, 0.0, 0.0, 0.0])]
    m = Matrix(spark.createDataFrame(rows, SCHEMA), NAMES)
    got = {(r["src"], r["dst"]): r["anomaly"] for r in similarity.anomaly_pairs(m).collect()}
    assert got == {(0, 1): None, (0, 2): 0, (1, 2): None}


@pytest.mark.parametrize("name", ["cosine_pairs", "anomaly_pairs"])
def test_pairs_of_copies_match_sql(spark, tmp_path, name):
    from oracle import connect, difference, spark_table, sql_table

    import __spark_entry__ as entry

    rng = np.random.default_rng(2)
    x = np.float32(rng.normal(size=(30, 64)) + 0.2)
    x[::3] = x[0]
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(x)] + [(1, x[1].tolist(), 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").toPandas().to_parquet(
        tmp_path / "embeddings.parquet")
    got = spark_table(entry.queries()[name](spark, str(tmp_path)))
    assert difference(got, sql_table(connect(str(tmp_path)), entry.oracle_sql()[name])) is None
    assert len(got[1]) >= 45 and (name == "cosine_pairs" or len(got[1]) == 30 * 29 // 2)


def test_weights_that_do_not_fit_an_int(spark):
    """The cosine of two rows is nearly minus their ratio, so the overall weight is huge."""
    x = np.array([[1.0, 0, 0, 0], [-0.5 - 1e-11, np.sqrt(0.75), 0, 0], [0, 0, 1.0, 0]])
    m = Matrix(spark.createDataFrame(rows_of(x, [1.0, 3.0, 2.0]), SCHEMA), NAMES)
    got = {(r["src"], r["dst"]): r for r in spanning.spanning_tree(m, "overall", "similar").collect()}
    assert len(got) == 2 and got[0, 1]["weight"] < -2.0 ** 31
    assert all(r["whole"] == int(r["weight"]) for r in got.values())


def test_dense_trees_match_kruskal():
    rng = np.random.default_rng(4)
    for n in range(200):
        p, q = (int(v) for v in rng.integers(1, 14, 2))
        same, ids = n % 2 == 0, rng.permutation(60)
        w = rng.integers(-2, 3, (p, p if same else q)).astype(float)  # many ties
        w[rng.random(w.shape) < 0.3] = np.inf
        row, column = np.sort(ids[:p]), np.sort(ids[p:p + q])
        place = np.argsort(np.argsort(np.concatenate([row, column])))
        if same:
            column, place = row, np.arange(p)
            w[np.tri(p, dtype=bool)] = np.inf
            w = np.minimum(w, w.T)
        edges = [(w[i, j], *sorted((int(row[i]), int(column[j])))) for i, j in np.argwhere(np.isfinite(w))
                 if not same or i < j]
        want = kruskal(60, edges)
        i, j = spanning._tree(w, place, same)
        assert len(i) == len(want) and {tuple(sorted((int(row[a]), int(column[b])))) for a, b in zip(i, j)} == want
        s, d, weight = (np.array([e[k] for e in edges]) for k in (1, 2, 0))
        keep = spanning._forest(s, d, weight, s, d) if edges else []
        assert {(int(s[e]), int(d[e])) for e in keep} == want
