import time

import numpy as np
import pytest

from docweave.operators import graph as G
from docweave.operators import models
from docweave.operators import vectors as V
from docweave.operators.components import connected_components

TRIANGLES = [("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0), ("d", "e", 1.0), ("d", "f", 1.0), ("e", "f", 1.0), ("c", "d", 0.1)]


def edges(spark, rows=TRIANGLES, doc="x"):
    return spark.createDataFrame([(doc, *r) for r in rows], "document_id string, i string, j string, sim double")


def vectors(spark, rows):
    return spark.createDataFrame([("x", f"c{k}", [float(y) for y in v]) for k, v in enumerate(rows)], "document_id string, chunk_uid string, embedding array<double>")


def test_pair_statistics_without_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 64))
    df = vectors(spark, x).repartition(5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T)[np.triu_indices(120, 1)]
    r = V.pair_statistics(df, "document_id").first()
    assert r.n_pairs == len(s) and abs(r["mean"] - s.mean()) < 1e-12 and abs(r["std"] - s.std()) < 1e-9


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(1)
    df = vectors(spark, rng.normal(size=(150, 8)))
    whole = V.group_neighbours(df, "document_id", "chunk_uid", 3).collect()
    cut = V.group_neighbours(df, "document_id", "chunk_uid", 3, block=20).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut)) and len(whole) == 450


@pytest.mark.parametrize("k, third, want", [(1, [0.3, -1 / 15, 815**0.5 / 30], {("c0", "c1")}), (1, [0.3, 13 / 30, (1 - 0.09 - (13 / 30) ** 2) ** 0.5], {("c0", "c1")})])
def test_mutual_neighbours_by_hand(spark, k, third, want):
    df = vectors(spark, [[1, 0, 0], [0.8, 0.6, 0], third])
    got = G.adaptive_topology(df, k, 0.1, 0, 5).collect()
    assert {(r.i, r.j) for r in got} == want and all(r.policy == "adaptive" for r in got) and abs(got[0].sim - 0.8) < 1e-9


def test_adaptive_keeps_degrees_within_bounds(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4, 16))
    df = vectors(spark, [base[i % 4] + 0.4 * rng.normal(size=16) for i in range(40)])
    got = G.adaptive_topology(df, 3, 0.1, 1, 4)
    d = {r.node: r.degree for r in G.degrees(got).collect()}
    assert len(d) == 40 and all(1 <= x <= 4 for x in d.values())
    again = G.adaptive_topology(df.repartition(7, "chunk_uid"), 3, 0.1, 1, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    for bad in ((0, 0.1, 1, 4), (3, 2.0, 1, 4), (3, 0.1, 5, 4)):
        with pytest.raises(ValueError):
            G.adaptive_topology(df, *bad)


def test_communities_of_two_triangles(spark):
    c = {r.node: r.community for r in G.communities(edges(spark)).collect()}
    assert c == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 1}
    part = spark.createDataFrame(list(c.items()), "node string, community int")
    assert abs(G.modularity(edges(spark), part).first().modularity - 2 * (3 / 6.1 - 0.25)) < 1e-9
    best = G.select_communities(G.community_candidates(edges(spark)), edges(spark)).first()
    assert best.resolution == 0.5 and best.score == 1.0


def test_coherence_inside_communities_decides(spark):
    ring = edges(spark, [("a", "b", 1.0), ("c", "d", 1.0), ("a", "c", 1.0), ("b", "d", 1.0)])
    parts = {0.5: {"a": 0, "b": 0, "c": 1, "d": 1}, 1.0: {"a": 0, "c": 0, "b": 1, "d": 1}}
    rows = [("x", r, s, n, c) for r, p in parts.items() for s in (17, 29) for n, c in p.items()]
    cand = spark.createDataFrame(rows, "document_id string, resolution double, seed int, node string, community int")
    vec = spark.createDataFrame([("x", n, v) for n, v in zip("abcd", ([1.0, 0.0], [0.0, 2.0], [0.8, 0.6], [0.0, 1.0]))], "document_id string, chunk_uid string, embedding array<double>")
    got = {(r.resolution, r.seed): round(r.semantic_coherence, 9) for r in G.candidate_metrics(cand, ring, vec).collect()}
    assert got == {(0.5, 17): 0.3, (0.5, 29): 0.3, (1.0, 17): 0.9, (1.0, 29): 0.9}
    best = G.select_communities(cand, ring, vec).first()
    assert (best.resolution, best.seed, best.score) == (1.0, 17, 1.0)
    few = G.select_communities(cand, ring, vec.where("chunk_uid = 'a'")).first()
    assert (few.resolution, few.score) == (0.5, 0.75)


def test_agreement(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 2), (3, 3)], "a int, b int")
    r = G.partition_agreement(df, df.a, df.b).first()
    assert abs(r.ari - 1) < 1e-9 and abs(r.nmi - 1) < 1e-9
    one = df.selectExpr("a", "1 as b")
    assert abs(G.partition_agreement(one, one.a, one.b).first().ari) < 1e-9


def test_centralities_of_a_path(spark):
    c = {r.node: r for r in G.centralities(edges(spark, [("a", "b", 1.0), ("b", "c", 1.0)])).collect()}
    assert c["b"].betweenness == 1.0 and c["a"].betweenness == 0.0 and c["b"].degree == 1.0 and c["b"]["rank"] == 1
    assert abs(c["b"].eigenvector - 0.5**0.5) < 1e-4 and abs(sum(r.pagerank for r in c.values()) - 1) < 1e-6
    p = {r.node: r.pagerank for r in G.pagerank(edges(spark, [("a", "b", 1.0), ("b", "c", 1.0)]), rounds=80).collect()}
    assert all(abs(p[n] - c[n].pagerank) < 1e-5 for n in p)


def test_components(spark):
    rows = [(str(i), str(i + 1)) for i in range(60)] + [("x", "y"), ("z", "z"), ("q", None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert {got[str(i)] for i in range(61)} == {"0"} and got["y"] == "x" and got["z"] == "z" and "q" not in got
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_average_linkage():
    x = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]])
    assert models.average_linkage(x, 2).tolist() == [0, 0, 1, 1] and len(set(models.average_linkage(x, 9))) == 4


def _arcs_of(n, pairs):
    src, dst, ww = (np.array(x) for x in zip(*[(*p, w) for i, j, w in pairs for p in ((i, j), (j, i))]))
    adj = [[] for _ in range(n)]
    for a, b, w in sorted(zip(src.tolist(), dst.tolist(), ww.tolist())):
        adj[a].append((b, w))
    return src, dst, ww, adj


def test_betweenness_of_many_sources_at_once_equals_one_by_one():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(3, 25))
        # a ring, so that every node has an edge, and chords; few lengths, so that many paths are equally short
        pairs = {(min(i, (i + 1) % n), max(i, (i + 1) % n)) for i in range(n)} | {tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(n)}
        src, dst, ww, adj = _arcs_of(n, [(i, j, float(rng.choice([0.1, 0.3, 0.6, 0.9, 1.0]))) for i, j in sorted(pairs)])
        want = G.betweenness(n, adj, range(n))
        for cells in (1, 60, 10_000):
            assert np.allclose(G.betweenness_of_arcs(n, src, dst, ww, np.arange(n), cells), want, atol=1e-9)
    # lengths of nothing, which no round can rest on
    src, dst, ww, adj = _arcs_of(4, [(0, 1, 0.0), (1, 2, 0.5), (2, 3, 0.5)])
    assert np.allclose(G.betweenness_of_arcs(4, src, dst, ww, np.arange(4)), G.betweenness(4, adj, range(4)))


def test_betweenness_of_a_large_document_takes_a_fraction_of_the_time():
    rng = np.random.default_rng(6)
    n = 6000
    pairs = {tuple(sorted((i, int(j)))) for i in range(n) for j in (*rng.integers(0, n, 1), (i + 1) % n, (i + 7) % n) if i != j}
    src, dst, ww, adj = _arcs_of(n, [(i, j, float(rng.uniform(0.3, 1.0))) for i, j in sorted(pairs)])
    sources = np.arange(0, n, 100)
    t = time.process_time()
    want = G.betweenness(n, adj, sources.tolist())
    slow, t = time.process_time() - t, time.process_time()
    assert np.allclose(G.betweenness_of_arcs(n, src, dst, ww, sources), want, atol=1e-6)
    assert time.process_time() - t < slow / 3


def test_betweenness_of_lengths_and_depths_of_all_kinds():
    rng = np.random.default_rng(7)
    chain = [(i, i + 1, 0.5) for i in range(400)]
    apart = [(10 * c + i, 10 * c + j, float(rng.choice([0.5, 0.6, 0.75]))) for c in range(6) for i in range(10) for j in range(i + 1, 10) if j == i + 1 or rng.random() < 0.3]
    unlike = [(i, j, float(10 ** rng.uniform(-7, 2))) for i in range(30) for j in range(i + 1, 30) if j == i + 1 or rng.random() < 0.1]
    # two ways that differ by less than single precision tells
    close = [(0, 1, 0.5), (1, 3, 0.500000001), (0, 2, 0.500000002), (2, 3, 0.5), (3, 4, 0.7), (0, 5, 0.25), (5, 3, 0.750000001)]
    for n, pairs in ((401, chain), (60, apart), (30, unlike), (6, close)):
        src, dst, ww, adj = _arcs_of(n, pairs)
        want = G.betweenness(n, adj, range(n))
        assert np.allclose(G.betweenness_of_arcs(n, src, dst, ww, np.arange(n)), want, rtol=1e-9, atol=1e-9)


def test_tiles_of_sources_add_up_and_edges_are_searched_for_once(spark):
    rng = np.random.default_rng(8)
    rows = [("big", f"n{i:03d}", f"n{j:03d}", float(rng.choice([0.4, 0.5, 0.9]))) for i in range(120) for j in range(i + 1, 120) if rng.random() < 0.03]
    rows += [(f"d{k}", x, y, s) for k in range(5) for x, y, s in TRIANGLES]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame(rows, "document_id string, i string, j string, sim double")
    cut = G.centralities(df.mapInPandas(count, df.schema), sources=20).collect()
    assert seen.value == len(rows)
    whole = {(r.document_id, r.node): r for r in G.centralities(df).collect()}
    assert len(cut) == len(whole) and all(r.betweenness is not None and abs(r.betweenness - whole[r.document_id, r.node].betweenness) < 1e-9 and r["rank"] == whole[r.document_id, r.node]["rank"] for r in cut)


def test_best_columns_are_picked_without_a_sort():
    rng = np.random.default_rng(9)
    s = np.round(rng.normal(size=(400, 2000)), 1)
    s[3], s[5, 7] = -np.inf, np.nan
    i, j = np.array([f"a{k}" for k in range(400)], dtype=object), np.array([f"b{k:04d}" for k in rng.permutation(2000)], dtype=object)
    got = {}
    for x, y, v in zip(*V._best(s.copy(), i, j, 3)):
        got.setdefault(x, []).append((y, v))
    for k, x in enumerate(i):
        want = sorted(((-v, y) for v, y in zip(s[k], j) if v > -np.inf), key=lambda p: p)[:3]
        assert [(y, -v) for v, y in want] == got.get(x, [])
    t = time.process_time()
    np.argsort(-s, axis=1, kind="stable")
    sort, t = time.process_time() - t, time.process_time()
    V._best(s, i, j, 3)
    assert time.process_time() - t < sort


def test_groups_stay_whole_across_batches(spark):
    import pandas as pd

    rows = pd.DataFrame({"g": list("aaabbbbbbbbcdde"), "n": range(15)})
    for size in (1, 2, 4, 15):
        got = [b["n"].tolist()[p:q] for b, c in V.whole_groups((rows.iloc[k : k + size] for k in range(0, 15, size)), "g") for p, q in zip(c[:-1], c[1:])]
        assert got == [[0, 1, 2], list(range(3, 11)), [11], [12, 13], [14]]
    assert not list(V.whole_groups([], "g")) and not list(V.whole_groups([rows.iloc[:0]], "g"))
    rng = np.random.default_rng(10)
    many = [(f"d{g}", f"c{g}-{k}", rng.integers(-2, 3, 4).astype(float).tolist()) for g in range(40) for k in range(1 + g % 9)]
    df = spark.createDataFrame([r for r in many if any(r[2])], "document_id string, chunk_uid string, embedding array<double>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        small = V.group_neighbours(df, "document_id", "chunk_uid", 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    cut = V.group_neighbours(df, "document_id", "chunk_uid", 3, block=2).collect()
    assert small and sorted(map(tuple, small)) == sorted(map(tuple, cut))


def test_blocks_grow_when_they_would_be_many(spark):
    rng = np.random.default_rng(11)
    df = vectors(spark, np.round(rng.normal(size=(300, 3)), 1) + [0, 0, 9])
    whole = sorted(map(tuple, V.group_neighbours(df, "document_id", "chunk_uid", 3).collect()))
    # 75 blocks of 4 rows would be 8 of 38, 300 of one row would be 19
    for block in (4, 1):
        cut = V.group_neighbours(df, "document_id", "chunk_uid", 3, block=block)
        assert sorted(map(tuple, cut.collect())) == whole
    x = np.array(["b", "a", "a", "a", "b"]), np.array([4, 3, 2, 1, 5]), np.array([0.5, 0.5, 0.5, 0.7, 0.9])
    assert [c.tolist() for c in V._nearest(*x, 2)] == [["a", "a", "b", "b"], [1, 2, 5, 4], [0.7, 0.5, 0.9, 0.5]]
