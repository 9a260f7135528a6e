import numpy as np

from docweave.llm.knn import knn, similar_pairs


def data(n=1500, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 64))
    x = [base[i % 60] + rng.normal(size=64) * rng.choice([0.15, 0.4, 3.0]) for i in range(n)]
    x[5] = x[6] = x[7]
    x[8] = x[7] * 2.5
    return {f"u{i:04d}": v for i, v in enumerate(x)}


def brute(vectors, k):
    ids = sorted(vectors)
    v = np.stack([vectors[i] for i in ids])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(v @ v.T, 9)
    np.fill_diagonal(s, -9)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(ids[i], ids[j]): s[i, j] for i in range(len(ids)) for j in order[i]}


def test_recall_and_form(spark):
    v = data()
    bad = [("n1", None), ("n2", []), ("n3", [1.0] * 32), ("n4", [0.0] * 64), ("n5", [float("nan")] + [1.0] * 63), ("n6", [float("inf")] + [1.0] * 63), ("n7", [None] + [1.0] * 63), (None, [1.0] * 64)]
    rows = [(u, x.tolist()) for u, x in v.items()] + bad + [("u0003", v["u0003"].tolist())]
    df = spark.createDataFrame([(u, x, 0.0) for u, x in rows], "chunk_uid string, embedding array<double>, cosine double")
    want = brute(v, 10)
    near = {(r.chunk_uid, r.neighbour): r.cosine for r in knn(df).collect()}
    assert all(abs(want[p] - c) < 1e-8 for p, c in near.items() if p in want)
    assert len(set(near) & set(want)) >= 0.9 * len(want)
    wanted = {tuple(sorted(p)) for p, c in want.items() if c >= 0.8}
    found = {(r.a, r.b) for r in similar_pairs(df, 0.8).collect()}
    assert len(found & wanted) >= 0.99 * len(wanted) and len(found - wanted) <= 0.01 * len(wanted)
    assert ("u0005", "u0006") in found


def test_many_copies_and_few_rows(spark):
    one = [float(i) for i in range(64)]
    df = spark.createDataFrame([(f"c{i:03d}", one) for i in range(50)], "chunk_uid string, embedding array<double>")
    near = {}
    for r in knn(df).collect():
        near.setdefault(r.chunk_uid, []).append(r.neighbour)
    assert sorted(near["c000"]) == [f"c{i:03d}" for i in range(1, 11)] and sorted(near["c040"]) == [f"c{i:03d}" for i in range(10)]
    assert knn(df.limit(0)).count() == 0 and knn(df.limit(1)).count() == 0


def test_long_lists_are_divided_and_queries_chosen(spark):
    v = data(6000, 9)
    df = spark.createDataFrame([(u, x.tolist()) for u, x in v.items()], "chunk_uid string, embedding array<double>")
    asked = df.where("int(substring(chunk_uid, 2)) % 50 = 0").select("chunk_uid")
    want = {p: c for p, c in brute(v, 10).items() if int(p[0][1:]) % 50 == 0}
    # 40 lists of which 6 are visited; 100 lists of which those of more than 100 rows are divided
    for kw in ({"list_rows": 150}, {"list_rows": 60, "split": 100, "probes": 40}):
        near = {(r.chunk_uid, r.neighbour) for r in knn(df, queries=asked, **kw).collect()}
        assert len(near) == len(want) == 1200 and len(near & set(want)) >= 0.9 * len(want), kw
