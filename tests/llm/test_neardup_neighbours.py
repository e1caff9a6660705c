import numpy as np

from tessera.llm import neardup as nd
from tessera.llm import neighbours as nb


def records(n=60, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [f"w{rng.integers(0, 10**6)}" for _ in range(60)]
        for j in range(4):  # small edits, also none
            w = list(words)
            for _ in range(j * 3):
                w[rng.integers(0, len(w))] = f"x{rng.integers(0, 10**6)}"
            rng.shuffle(w)
            out.append((i * 10 + j, " ".join(w[:30]), " ".join(w[30:]), "kind"))
    return out + [(9001, None, None, None), (9002, "", "", ""), (9003, "same a b", None, None), (9004, "B a SAME", "", None), (None, "same a b", "", "")]


def test_pairs_equal_brute_force(spark):
    rows = records()
    df = spark.createDataFrame(rows, "id long, a string, b string, words string")
    member, pairs = nd.near_duplicates(df, "id", ["a", "b", "words"])
    got = {(r["a"], r["b"]) for r in nd.all_pairs(member, pairs).collect()}
    sets = {r[0]: {w.lower() for x in r[1:] if x for w in x.split()} for r in rows if r[0] is not None}
    sets = {k: v for k, v in sets.items() if v}
    ids = sorted(sets)
    expected = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert got == expected and (9003, 9004) in got
    groups = {r["id"]: r["group_id"] for r in nd.groups(member, pairs).collect()}
    assert set(groups) == set(sets) and all(groups[a] == groups[b] for a, b in expected)
    empty = nd.near_duplicates(df.limit(0), "id", ["a"])
    assert empty[0].count() == 0 and nd.all_pairs(*empty).count() == 0


def test_buckets_lose_nothing(spark):
    rows = [(i, 1) for i in range(70)] + [(i, 2 + i % 3) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, key long")
    got = [(r["a"], r["b"]) for r in nd.bucket_pairs(df, block=8).collect()]
    assert len(got) == len(set(got)) == 70 * 69 // 2


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-(2**62), 2**62, 400), rng.integers(-(2**62), 2**62, 400)
    b[:300] = a[:300]
    one = lambda x: nd.registers(np.sort(x), np.array([0]), 2048)
    assert (nd.merge(one(a), one(b)) == one(np.union1d(a, b))).all()
    est = nd.joint_estimate(one(a), one(b), np.array([400.0]), np.array([400.0]))[0]
    assert abs(est - 300 / 500) < 0.05


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    v = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))).astype(np.float32)
    v[500:520] = v[3]  # exact copies
    data = [(int(i), [float(x) for x in row]) for i, row in enumerate(v)] + [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16)]
    df = spark.createDataFrame(data, "id long, vec array<float>")
    got = {}
    for r in nb.nearest(df, "id", "vec", dim=16).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["neighbour"]
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    cos = np.round(u @ u.T, 9)
    np.fill_diagonal(cos, -2)
    expected = {i: [int(x) for x in np.lexsort((np.arange(900), -cos[i]))[:5]] for i in range(900)}
    assert set(got) == set(range(900)) and all(len(x) == 5 for x in got.values())
    hits = sum(len(set(expected[i]) & set(got[i].values())) for i in expected)
    assert hits >= 0.95 * 4500
    assert [got[510][k] for k in sorted(got[510])] == [3, 500, 501, 502, 503] and [got[3][k] for k in sorted(got[3])] == [500, 501, 502, 503, 504]
    assert nb.nearest(df.limit(0), "id", "vec", dim=16).count() == 0
    assert nb.nearest(df.filter("id < 2"), "id", "vec", dim=16).count() == 2


def test_large_files_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<float>")
    whole = {(r["id"], r["neighbour"]) for r in nb.nearest(df, "id", "vec", dim=8).collect()}
    monkeypatch.setattr(nb, "BLOCK", 16)
    cut = {(r["id"], r["neighbour"]) for r in nb.nearest(df, "id", "vec", dim=8).collect()}
    assert len(whole & cut) >= 0.97 * len(whole)


def test_many_vectors_of_one_direction(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    of = rng.permutation(600)
    v[of[:200]] = (v[of[0]] * rng.uniform(0.2, 5, size=(200, 1))).astype(np.float32)  # scaled copies, none of them equal
    v[of[200:240]] = (v[of[200]] * rng.uniform(0.2, 5, size=(40, 1))).astype(np.float32)  # too few to be crowded
    v[of[240:300]] = v[of[0]] + 0.3 * rng.normal(size=(60, 16))  # near to the crowd: its order is in the last decimals
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<float>")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    cos = np.round(u @ u.T, 9)
    np.fill_diagonal(cos, -2)
    monkeypatch.setattr(nb, "BLOCK", 64)
    got = {}
    for r in nb.nearest(df, "id", "vec", dim=16, visited=24, posted=24, reranked=1.0).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["cosine"]))
    for i in range(600):
        best = np.lexsort((np.arange(600), -cos[i]))[:5]
        assert [j for j, _ in got[i]] == best.tolist(), i
        assert np.allclose([c for _, c in got[i]], cos[i][best], atol=1.1e-9, rtol=0)


def test_groups_have_a_row_for_every_pattern(spark, tmp_path):
    from tessera.llm import queries

    fields = ", ".join(f"{c} string" for c in queries.PATTERN_FIELDS)
    texts = [(1, "a b c d"), (2, "d c b a"), (3, None), (4, "— é"), (5, "other words"), (None, "a b c d")]
    rows = [(i, t, *[None] * (len(queries.PATTERN_FIELDS) - 1)) for i, t in texts]
    spark.createDataFrame(rows, f"pattern_id long, {fields}").write.parquet(str(tmp_path / "migration_patterns.parquet"))
    got = sorted((r["pattern_id"], r["class_id"], r["group_id"], r["n_links"]) for r in queries.p1_groups(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 1, 0), (2, 1, 1, 0), (3, 3, 3, 0), (4, 4, 4, 0), (5, 5, 5, 0)]


def test_repeated_ids_are_one_record_and_lose_no_link(spark, rows):
    words = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, words), (1, "other " + words), (2, words + " more"), (3, "x y z"), (3, "x y z"), (None, words)], "id long, t string")
    member, pairs = nd.near_duplicates(df, "id", ["t"])
    assert rows(member.select("id")) == [(1,), (2,), (3,)]
    assert rows(nd.all_pairs(member, pairs)) == [(1, 2)]


def test_large_classes_meet_in_blocks(spark, rows):
    member = spark.createDataFrame([(i, 0) for i in range(40)] + [(i, 100) for i in range(100, 117)] + [(500, 500)], "id long, class_id long")
    pairs = spark.createDataFrame([(0, 100, 0.9), (100, 500, 0.8)], "a long, b long, similarity double")
    got = rows(nd.all_pairs(member, pairs, block=5))
    a, b = range(40), range(100, 117)
    want = {(x, y) for c in (a, b) for x in c for y in c if x < y} | {(x, y) for x in a for y in b} | {(y, 500) for y in b}
    assert len(got) == len(set(got)) and set(got) == want
