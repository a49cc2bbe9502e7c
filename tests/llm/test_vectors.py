import numpy as np
import pytest

from lumenfold.llm import vectors

DIMS = {"a": 64, "b": 48}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for c, d in DIMS.items():
        for g in range(8):
            centre = rng.normal(size=d)
            for _ in range(60 if g < 6 else 3):
                n += 1
                rows.append((n, c, (3 * rng.random() + 0.5) * (centre / np.linalg.norm(centre) + 0.5 / np.sqrt(d) * rng.normal(size=d)), "x, y" if g else ""))
    rows = [(i, c, [float(x) for x in np.float32(v)], t) for i, c, v, t in rows]
    same = rows[5]
    rows += [(n + 1 + k, same[1], same[2], None) for k in range(40)]
    n += 50
    rows += [(n + 1, "a", None, ""), (n + 2, "a", [], ""), (n + 3, "a", [0.0] * 64, ""), (n + 4, "a", [1.0] * 48, ""), (n + 5, "a", [float("nan")] * 64, ""), (n + 6, "c", [1.0] * 64, ""), (n + 7, "a", [None] * 64, ""), (n + 8, None, [1.0] * 64, "")]
    rows += [(n + 20 + k, "a", [0.0] * 64, "") for k in range(6)] + [(n + 30 + k, "a", [None] * 64, "") for k in range(6)]
    good = [r for r in rows if r[1] in DIMS and r[2] and len(r[2]) == DIMS[r[1]] and all(x is not None and x == x for x in r[2]) and any(r[2])]
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_no long, collection_name string, embedding array<float>, tags string, h int").repartition(4), good


def brute(good, c):
    own = [r for r in good if r[1] == c]
    x = np.array([r[2] for r in own], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.array([r[0] for r in own]), np.round(x @ x.T, 10)


def test_nearest_against_brute_force(data):
    df, good = data
    got = {}
    for r in vectors.nearest(df, df.filter("vec_no % 3 = 0"), DIMS, k=5, short=20, short_share=0.3, probes=6).collect():
        got.setdefault(r.vec_no, []).append((r.rank, r.neighbour))
    hit = total = 0
    for c in DIMS:
        no, s = brute(good, c)
        for i, v in enumerate(no):
            if v % 3 == 0:
                o = [no[j] for j in np.lexsort((no, -s[i])) if j != i][:5]
                total += 5
                hit += len({x for _, x in got[v]} & set(o))
    assert hit / total > 0.9 and len(got) == sum(1 for r in good if r[0] % 3 == 0)


def test_ties_take_the_smaller_key(data):
    df, good = data
    same = sorted(r[0] for r in good if r[2] == good[5][2])
    rows = vectors.nearest(df, df.filter(df.vec_no == same[-1]), DIMS, k=5).orderBy("rank").collect()
    assert [r.neighbour for r in rows] == same[:5] and len(same) == 41


def test_cut_lists_agree(data):
    df, _ = data
    a = sorted(map(tuple, vectors.nearest(df, df.filter("vec_no < 40"), DIMS, k=3).collect()))
    b = sorted(map(tuple, vectors.nearest(df, df.filter("vec_no < 40"), DIMS, k=3, list_rows=10).collect()))
    c = sorted(map(tuple, vectors.nearest(df, df.filter("vec_no < 40"), DIMS, k=3, first_words=4, probes=64).collect()))
    assert a == b == c


def test_whole_index_with_copies_shuffled_joins(data):
    """Every row asks; vectors repeated more often than k times ask once, also where their keys are not broadcast."""
    df, good = data
    a = sorted(map(tuple, vectors.nearest(df, df, DIMS, k=3).collect()))
    b = sorted(map(tuple, vectors.nearest(df, df, DIMS, k=3, most_known=0).collect()))
    assert a == b
    by = {}
    for q, x, _, _ in a:
        by.setdefault(q, []).append(x)
    same = sorted(r[0] for r in good if r[2] == good[5][2])
    assert len(by) == len(good) and all(set(by[v]) == set([x for x in same if x != v][:3]) for v in same)


def test_groups_against_brute_force(data):
    df, good = data
    want = {}
    for c in DIMS:
        no, s = brute(good, c)
        root = vectors.components(len(no), *np.nonzero(s >= 0.6))
        for r in set(root):
            m = no[root == r]
            if len(m) >= 5:
                want |= {int(v): int(m.min()) for v in m}
    got = vectors.similar_groups(df, DIMS, cell_rows=100)
    assert {r.vec_no: r.cluster_no for r in got.collect()} == want
    about = vectors.describe_groups(got, df).collect()
    assert {r.cluster_no for r in about} == set(want.values())
    for r in about:
        m = [int(x) for x in r.typical_members.split(",")]
        assert len(m) == 3 and all(want[x] == r.cluster_no for x in m) and r.typical_tags in ("", "x,y")


def test_enough_copies_alone_are_a_group(spark):
    rows = [(i, "a", [1.0] + [0.0] * 63) for i in range(6)] + [(10, "a", [0.0, 1.0] + [0.0] * 62)]
    df = spark.createDataFrame(rows, "vec_no long, collection_name string, embedding array<float>")
    assert sorted((r.vec_no, r.cluster_no) for r in vectors.similar_groups(df, DIMS).collect()) == [(i, 0) for i in range(6)]


@pytest.mark.parametrize(("copies", "hot_rows"), [(400, 100), (1, 30)])
def test_crowded_cells_keep_their_links(spark, copies, hot_rows):
    """Vectors that are similar to one vector only, which is often repeated or stands in a cell of many vectors."""
    rng = np.random.default_rng(4)
    x = np.eye(128)[1:61] * 0.78 + np.eye(128)[0] * 0.626  # cosine 0.626 to the first axis, 0.39 to each other
    x = [np.eye(128)[0]] * copies + list(x) + list(rng.normal(size=(90, 128)))
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(np.float32(x))], "vec_no long, collection_name string, embedding array<float>")
    got = vectors.similar_groups(df, {"a": 128}, hot_rows=hot_rows)
    assert sorted((r.vec_no, r.cluster_no) for r in got.collect()) == [(i, 0) for i in range(copies + 60)]


@pytest.mark.parametrize("kw", [{}, {"hot_rows": 300}, {"hot_rows": 150}, {"hot_rows": 60}, {"cell_rows": 100}, {"pass_rows": 200, "cell_rows": 50}])
def test_small_groups_stay_whole_however_cells_are_cut(spark, kw):
    """120 groups of 5 near-equal vectors."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(120, 32))
    x = (centre[:, None] + 0.1 * rng.normal(size=(120, 5, 32))).reshape(600, 32)
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(np.float32(x))], "vec_no long, collection_name string, embedding array<float>").repartition(4)
    got = {r.vec_no: r.cluster_no for r in vectors.similar_groups(df, {"a": 32}, **kw).collect()}
    assert len(got) == 600 and all(got[i] <= i // 5 * 5 for i in got) and all(len({got[g * 5 + j] for j in range(5)}) == 1 for g in range(120))


def test_components_that_do_not_end_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        vectors.linked(chain, "t", most=2)


def test_empty_tables(spark, data):
    df, _ = data
    none = df.limit(0)
    assert vectors.nearest(none, none, DIMS).count() == vectors.nearest(df, none, DIMS).count() == vectors.similar_groups(none, DIMS).count() == vectors.similar_groups(df, {}).count() == 0


def test_neighbour_descent_finds_most():
    x = vectors.unit(np.random.default_rng(1).normal(size=(1500, 10)).astype(np.float32))
    ids, _ = vectors.neighbour_descent(x, 10, rounds=8)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, want)]) > 0.9


def test_communities_of_two_cliques():
    i, j = np.triu_indices(6, 1)
    a, b = np.r_[i, i + 6, 0], np.r_[j, j + 6, 6]
    c = vectors.communities(12, a, b, np.ones(len(a)))
    assert len(set(c[:6])) == 1 and len(set(c[6:])) == 1 and c[0] != c[6]


def test_linked(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (3, 9), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in vectors.linked(e, "t").collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 7: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in vectors.linked(chain, "t").collect()} == {0}
