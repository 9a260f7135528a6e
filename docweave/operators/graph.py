"""Graph operators over edges (document_id, i, j, sim), i < j, one edge per pair.

Sums over edges are plain aggregations. What is sequential by nature (greedy topology, community search, shortest paths) runs
per document, the unit all edges stay within; its memory is linear in the document's nodes and edges.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release
from . import vectors as V

#: Resolutions and seeds of the community search, and the baseline's seed.
RESOLUTIONS, SEEDS, BASELINE_SEED = (0.5, 1.0, 1.5), (17, 29, 43), 17
#: Edges of a document for each tile of sources of its shortest paths, and the most tiles, for each holds all its edges.
SOURCES, TILES = 2000, 64
#: Rows lowered at once, cells settled at once, and steps told apart, by the search for shortest paths.
ROWS, CELLS, STEPS = 1024, 100_000, 255


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("document_id", F.col("i").alias("node"), "sim").unionByName(edges.select("document_id", F.col("j").alias("node"), "sim"))


def degrees(edges: DataFrame) -> DataFrame:
    return _ends(edges).groupBy("document_id", "node").agg(F.count(F.lit(1)).alias("degree"))


def strengths(edges: DataFrame) -> DataFrame:
    return _ends(edges).groupBy("document_id", "node").agg(F.sum("sim").alias("strength"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"))
    d = nodes.join(n, "document_id").join(degrees(edges), ["document_id", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))
    return d.select("document_id", "node", "degree", F.when(F.col("_n") > 1, F.col("degree") / (F.col("_n") - 1)).otherwise(0.0).alias("centrality"))


def topology_metrics(nodes: DataFrame, edges: DataFrame, most_degree: int) -> DataFrame:
    """Per document: nodes, edges, orphans, the highest degree, nodes at the bound, density."""
    d = degrees(edges).groupBy("document_id").agg(F.count(F.lit(1)).alias("_with"), F.max("degree").alias("_most"), F.count_if(F.col("degree") >= most_degree).alias("_at"))
    n = nodes.groupBy("document_id").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("document_id").agg(F.count(F.lit(1)).alias("_edges"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    g = n.join(e, "document_id", "left").join(d, "document_id", "left")
    density = F.when(F.col("nodes") > 1, F.lit(2.0) * z("_edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return g.select("document_id", "nodes", z("_edges").alias("edges"), (F.col("nodes") - z("_with")).alias("orphans"), z("_most").alias("most_degree"), z("_at").alias("at_most"), F.round(density, 6).alias("density"))


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(document_id, modularity) of a partition (node, community); the weight of an edge is its similarity."""
    p = partition.select("node", "community")
    a, b = p.select(F.col("node").alias("i"), F.col("community").alias("_a")), p.select(F.col("node").alias("j"), F.col("community").alias("_b"))
    e = edges.join(a, "i").join(b, "j").select("document_id", "sim", "_a", "_b")
    ends = e.select("document_id", F.explode(F.array("_a", "_b")).alias("community"), "sim")
    deg = ends.groupBy("document_id", "community").agg(F.sum("sim").alias("_deg"))
    inner = e.where("_a = _b").groupBy("document_id", F.col("_a").alias("community")).agg(F.sum("sim").alias("_in"))
    m = e.groupBy("document_id").agg(F.sum("sim").alias("_m"))
    part = F.coalesce("_in", F.lit(0.0)) / F.col("_m") - F.pow(F.col("_deg") / (2 * F.col("_m")), 2)
    return deg.join(inner, ["document_id", "community"], "left").join(m, "document_id").groupBy("document_id").agg(F.sum(part).alias("modularity"))


def partition_agreement(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row (ari, nmi): adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings.

    Only the table of counts is worked on. Two partitions of one class each agree fully.
    """
    c = rows.groupBy(a.alias("_a"), b.alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # one pass with margins by grouping sets: (a, b), (a), (b), ()
    g = c.cube("_a", "_b").agg(F.sum("n").alias("n"), F.grouping("_a").alias("_ga"), F.grouping("_b").alias("_gb"))
    pairs, info = F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum(F.col("n") * F.log("n"))
    s = g.groupBy().agg(*[f.alias(f"{name}{x}{y}") for x in (0, 1) for y in (0, 1) for name, f in (("p", F.sum(F.when((F.col("_ga") == x) & (F.col("_gb") == y), F.col("n") * (F.col("n") - 1) / 2))), ("h", F.sum(F.when((F.col("_ga") == x) & (F.col("_gb") == y), F.col("n") * F.log("n")))), ("n", F.sum(F.when((F.col("_ga") == x) & (F.col("_gb") == y), F.col("n")))))])
    ij, i, j, whole, n = F.col("p00"), F.col("p01"), F.col("p10"), F.col("p11"), F.col("n11")
    expected = i * j / F.nullif(whole, F.lit(0.0))
    most = (i + j) / 2
    ari = F.when(most == expected, 1.0).otherwise((ij - expected) / (most - expected))
    ha, hb = F.log(n) - F.col("h01") / n, F.log(n) - F.col("h10") / n
    mi = ha + hb - (F.log(n) - F.col("h00") / n)
    return s.select(ari.alias("ari"), F.when(ha + hb < 1e-12, 1.0).otherwise(mi / ((ha + hb) / 2)).alias("nmi"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(document_id, node, pagerank) after a fixed number of rounds, weighted by similarity, within each document.

    Nodes without edges are not in the table, so there is no dangling mass. Lineage is cut every five rounds.
    """
    arcs = edges.select("document_id", F.col("i").alias("src"), F.col("j").alias("dst"), "sim").unionByName(edges.select("document_id", F.col("j").alias("src"), F.col("i").alias("dst"), "sim"))
    out = arcs.groupBy("document_id", "src").agg(F.sum("sim").alias("_w"))
    share = materialize(arcs.join(out, ["document_id", "src"]).select("document_id", "src", "dst", (F.col("sim") / F.col("_w")).alias("share")), "pagerank-arcs")
    nodes = share.select("document_id", F.col("src").alias("node")).distinct()
    nodes = materialize(nodes.join(nodes.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n")), "document_id"), "pagerank-nodes")
    rank = nodes.select("document_id", "node", (F.lit(1.0) / F.col("_n")).alias("pagerank"))
    kept = None
    for k in range(rounds):
        came = share.join(rank.withColumnRenamed("node", "src"), ["document_id", "src"]).groupBy("document_id", F.col("dst").alias("node")).agg(F.sum(F.col("pagerank") * F.col("share")).alias("_in"))
        rank = nodes.join(came, ["document_id", "node"], "left").select("document_id", "node", ((1 - damping) / F.col("_n") + damping * F.coalesce("_in", F.lit(0.0))).alias("pagerank"))
        if k % 5 == 4 and k + 1 < rounds:
            before, rank = kept, materialize(rank, "pagerank")
            kept = rank
            if before is not None:
                release(before)
    return rank


def _adapt(k: int, above: float, least: int, most: int):
    """Greedy topology of one document from its mutual pairs; see ``adaptive_topology``."""

    def run(key, nodes, pairs):
        cols = ["document_id", "i", "j", "sim", "policy"]
        nodes = nodes.sort_values("chunk_uid")
        ids = nodes["chunk_uid"].tolist()
        if not ids:
            return pd.DataFrame(columns=cols)
        at = {u: n for n, u in enumerate(ids)}
        v = np.stack([np.asarray(x, dtype=np.float64) for x in nodes["embedding"]])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        links: list[dict[int, float]] = [{} for _ in ids]
        good = pairs[pairs["kind"] == "mutual"].sort_values(["sim", "i", "j"], ascending=[False, True, True])
        for a, b, s in zip(good["i"], good["j"], good["sim"]):
            a, b = at[a], at[b]
            if len(links[a]) < most and len(links[b]) < most:
                links[a][b] = links[b][a] = s
        for a in range(len(ids)):
            if len(links[a]) >= least:
                continue
            # only a node short of links is compared with all others, one row at a time
            sims = np.round(v @ v[a], 9)
            sims[a] = -np.inf
            for b in np.lexsort((np.arange(len(ids)), -sims)):
                if len(links[a]) >= least or sims[b] < above:
                    break
                b = int(b)
                if b in links[a]:
                    continue
                if len(links[b]) >= most:
                    spare = [(s, c) for c, s in links[b].items() if len(links[c]) > least]
                    if not spare:
                        continue
                    c = min(spare)[1]
                    del links[b][c], links[c][b]
                links[a][b] = links[b][a] = float(sims[b])
        if any(len(x) < least for x in links):
            fixed = pairs[pairs["kind"] == "fixed"]
            return pd.DataFrame({"document_id": key[0], "i": fixed["i"], "j": fixed["j"], "sim": fixed["sim"], "policy": "fixed"}, columns=cols)
        rows = [(key[0], ids[a], ids[b], s, "adaptive") for a, x in enumerate(links) for b, s in x.items() if a < b]
        return pd.DataFrame(rows, columns=cols)

    return run


def adaptive_topology(vectors: DataFrame, k: int, above: float, least: int, most: int) -> DataFrame:
    """(document_id, i, j, sim, policy): mutual neighbours above the document's cutoff, added by similarity while both ends have room;
    then nodes short of links take their best partners, if need be in place of a partner's weakest link it can spare. If a node stays short,
    the document falls back to the fixed policy. Cutoffs and neighbours are computed for all documents at once beforehand.
    """
    if not (isinstance(k, int) and k >= 1 and -1 <= above <= 1 and 0 <= least <= most):
        raise ValueError("k must be at least 1, the threshold within [-1, 1], and 0 <= least degree <= most degree")
    near = materialize(V.group_neighbours(vectors, "document_id", "chunk_uid", k), "topology-neighbours")
    cut = V.pair_statistics(vectors, "document_id").where("n_pairs > 0").select("document_id", F.round(F.col("mean") + 0.5 * F.col("std"), 9).alias("_cut"))
    good = V.mutual(near, "document_id").join(cut, "document_id").where("sim >= _cut").select("document_id", "i", "j", "sim", F.lit("mutual").alias("kind"))
    pairs = good.unionByName(V.either(near, "document_id", above).select("document_id", "i", "j", "sim", F.lit("fixed").alias("kind")))
    return vectors.groupBy("document_id").cogroup(pairs.groupBy("document_id")).applyInPandas(_adapt(k, above, least, most), "document_id string, i string, j string, sim double, policy string")


def louvain(n: int, edges: list[tuple[int, int, float]], resolution: float, seed: int) -> list[int]:
    """Community of each node by local moves and aggregation; the order of visits comes from the seed."""
    rng = np.random.default_rng(seed)
    label = list(range(n))
    adj: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        adj[a][b] = adj[a].get(b, 0.0) + w
        if a != b:
            adj[b][a] = adj[b].get(a, 0.0) + w
    total = sum(w for _, _, w in edges)
    if total <= 0:
        return label
    while True:
        size = len(adj)
        # a loop counts twice in its node's weight
        weight = [sum(x.values()) + x.get(i, 0.0) for i, x in enumerate(adj)]
        own, inside = list(range(size)), weight.copy()
        moved, any_move = True, False
        while moved:
            moved = False
            for a in rng.permutation(size).tolist():
                near: dict[int, float] = {}
                for b, w in adj[a].items():
                    if b != a:
                        near[own[b]] = near.get(own[b], 0.0) + w
                c = own[a]
                inside[c] -= weight[a]
                gain = lambda d: near.get(d, 0.0) - resolution * weight[a] * inside[d] / (2 * total)  # noqa: E731, B023
                best = c
                for d in sorted(near):
                    if gain(d) > gain(best) + 1e-12:
                        best = d
                inside[best] += weight[a]
                if best != c:
                    own[a], moved, any_move = best, True, True
        names = {c: k for k, c in enumerate(sorted(set(own)))}
        own = [names[c] for c in own]
        label = [own[x] for x in label]
        if not any_move or len(names) == size:
            return label
        small: list[dict[int, float]] = [{} for _ in names]
        for a, x in enumerate(adj):
            for b, w in x.items():
                if a <= b:
                    p, q = sorted((own[a], own[b]))
                    small[p][q] = small[p].get(q, 0.0) + w
        adj = [dict(x) for x in small]
        for a, x in enumerate(small):
            for b, w in x.items():
                if a != b:
                    adj[b][a] = w


def _renumber(ids: list[str], label: list[int]) -> list[int]:
    """Communities numbered from 0 in the order of their sorted members."""
    groups: dict[int, list[str]] = {}
    for u, c in zip(ids, label):
        groups.setdefault(c, []).append(u)
    order = {c: k for k, (_, c) in enumerate(sorted((sorted(m), c) for c, m in groups.items()))}
    return [order[c] for c in label]


def _search(settings: list[tuple[float, int]]):
    def run(key, b):
        ids = sorted({*b["i"], *b["j"]})
        at = {u: n for n, u in enumerate(ids)}
        b = b.sort_values(["i", "j"])
        # a weight that is no number counts as 1
        edges = [(at[x], at[y], float(s) if s is not None and np.isfinite(s) else 1.0) for x, y, s in zip(b["i"], b["j"], b["sim"])]
        rows = [(key[0], r, s, u, c) for r, s in settings for u, c in zip(ids, _renumber(ids, louvain(len(ids), edges, r, s)))]
        return pd.DataFrame(rows, columns=["document_id", "resolution", "seed", "node", "community"])

    return run


_CANDIDATES = "document_id string, resolution double, seed int, node string, community int"


def _search_one(key, b):
    return _search([(float(key[1]), int(key[2]))])((key[0],), b)


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = BASELINE_SEED) -> DataFrame:
    return edges.groupBy("document_id").applyInPandas(_search([(resolution, seed)]), _CANDIDATES).select("document_id", "node", "community")


def community_candidates(edges: DataFrame) -> DataFrame:
    """Partitions for each of three resolutions and three seeds, each searched in a task of its own."""
    tried = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(s).alias("s")) for r in RESOLUTIONS for s in SEEDS])).alias("_t")
    spread = edges.select("document_id", "i", "j", "sim", tried)
    return spread.groupBy("document_id", F.col("_t.r").alias("_r"), F.col("_t.s").alias("_s")).applyInPandas(_search_one, _CANDIDATES)


def _coherence(key, part, vecs):
    """Mean cosine of the pairs inside the communities of each candidate of a document, from one sum of unit vectors per community."""
    names = ["document_id", "resolution", "seed", "semantic_coherence"]
    if not len(part) or not len(vecs):
        return pd.DataFrame(columns=names)
    vecs = vecs.sort_values("_node")
    v = np.stack([np.asarray(x, dtype=np.float64) for x in vecs["_v"]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    at = {u: k for k, u in enumerate(vecs["_node"])}
    rows = []
    for (r, s), b in part[part["node"].isin(at)].sort_values("node").groupby(["resolution", "seed"]):
        codes, groups = pd.factorize(b["community"])
        x, total = v[[at[u] for u in b["node"]]], np.zeros((len(groups), v.shape[1]))
        np.add.at(total, codes, x)
        n = np.bincount(codes)
        pairs = (n * (n - 1)).sum() / 2
        if pairs:
            rows.append((key[0], r, s, float(((total * total).sum() - n.sum()) / 2 / pairs)))
    return pd.DataFrame(rows, columns=names)


def semantic_coherence(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """(document_id, resolution, seed, semantic_coherence): all pairs of a candidate weigh the same, whatever their community.

    Nodes without a vector are passed over; a candidate without a pair of vectors inside any community has no row.
    """
    v = vectors.where(V.valid_vector(F.col("embedding"))).select(F.col("document_id").alias("_doc"), F.col("chunk_uid").alias("_node"), F.col("embedding").cast("array<double>").alias("_v")).dropDuplicates(["_doc", "_node"])
    return candidates.groupBy("document_id").cogroup(v.groupBy("_doc")).applyInPandas(_coherence, "document_id string, resolution double, seed int, semantic_coherence double")


def candidate_metrics(candidates: DataFrame, edges: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Per document and candidate: sizes, quality, stability among the seeds of a resolution, coherence if there are vectors
    (document_id, chunk_uid, embedding), and whether it is acceptable."""
    keys = ["document_id", "resolution", "seed"]
    sizes = candidates.groupBy(*keys, "community").agg(F.count(F.lit(1)).alias("n"))
    s = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_communities"), F.sum("n").alias("n_nodes"), F.max("n").alias("largest"), F.min("n").alias("smallest"), (F.count_if(F.col("n") == 1) / F.count(F.lit(1))).alias("singleton_rate"))
    ends = edges.select("document_id", "i", "j", "sim").join(candidates.select(*keys, F.col("node").alias("i"), F.col("community").alias("_a")), ["document_id", "i"]).join(candidates.select(*keys, F.col("node").alias("j"), F.col("community").alias("_b")), [*keys, "j"])
    inner = ends.groupBy(*keys).agg(F.sum("sim").alias("_m"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("sim")).otherwise(0.0)).alias("_in"))
    deg = ends.select(*keys, F.explode(F.array("_a", "_b")).alias("c"), "sim").groupBy(*keys, "c").agg(F.sum("sim").alias("_d")).groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_d")).alias("_dd"))
    quality = inner.join(deg, keys).select(*keys, (F.col("_in") / F.col("_m") - F.col("_dd") / (4 * F.col("_m") * F.col("_m"))).alias("graph_quality"))
    other = candidates.select("document_id", "resolution", F.col("seed").alias("seed2"), "node", F.col("community").alias("community2"))
    cells = candidates.join(other, ["document_id", "resolution", "node"]).where("seed <> seed2").groupBy(*keys, "seed2", "community", "community2").agg(F.count(F.lit(1)).cast("double").alias("n"))
    p = [*keys, "seed2"]
    row = cells.groupBy(*p, "community").agg(F.sum("n").alias("n")).groupBy(*p).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("i"), F.sum(F.col("n") * F.log("n")).alias("hi"), F.sum("n").alias("n"))
    col = cells.groupBy(*p, "community2").agg(F.sum("n").alias("n")).groupBy(*p).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("j"), F.sum(F.col("n") * F.log("n")).alias("hj"))
    both = cells.groupBy(*p).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("ij"), F.sum(F.col("n") * F.log("n")).alias("hij"))
    t = row.join(col, p).join(both, p)
    whole = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("i") * F.col("j") / F.nullif(whole, F.lit(0.0))
    ari = F.when((F.col("i") + F.col("j")) / 2 == expected, 1.0).otherwise((F.col("ij") - expected) / ((F.col("i") + F.col("j")) / 2 - expected))
    ha, hb = F.log("n") - F.col("hi") / F.col("n"), F.log("n") - F.col("hj") / F.col("n")
    nmi = F.when(ha + hb < 1e-12, 1.0).otherwise((ha + hb - F.log("n") + F.col("hij") / F.col("n")) / ((ha + hb) / 2))
    stable = t.groupBy(*keys).agg(((F.avg(F.coalesce(ari, F.lit(1.0))) + F.avg(nmi)) / 2).alias("stability"))
    m = s.join(quality, keys).join(stable, keys)
    if vectors is not None:
        m = m.join(semantic_coherence(candidates, vectors), keys, "left")
    bad = (F.col("n_communities") > F.greatest(F.lit(2), F.ceil(F.col("n_nodes") * 0.75))) | (F.col("singleton_rate") > 0.5) | ((F.col("n_communities") > 1) & (F.col("largest") / F.col("n_nodes") > 0.9))
    return m.withColumn("size_balance", F.col("smallest") / F.col("largest")).withColumn("accepted", ~bad)


def select_communities(candidates: DataFrame, edges: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(document_id, resolution, seed, score): the accepted candidate of the best mean of min-max scaled metrics, ties to
    the lower resolution, then seed; a document without an acceptable one keeps resolution 1 and the baseline's seed, score null.

    The metrics are quality, stability, balance of sizes and, with vectors, coherence; a missing one counts 0. They are rounded
    before they are scaled, so that equal partitions are not told apart by the order of a sum.
    """
    candidates = materialize(candidates, "community-candidates")
    m = candidate_metrics(candidates, edges, vectors)
    w = Window.partitionBy("document_id")
    names = ["graph_quality", "stability", "size_balance"] + (["semantic_coherence"] if vectors is not None else [])
    ok = m.where("accepted").withColumns({c: F.round(c, 12) for c in names})
    scaled = [F.when(F.col(c).isNull(), 0.0).when(F.max(c).over(w) == F.min(c).over(w), 1.0).otherwise((F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w))) for c in names]
    scored = ok.withColumn("score", F.round(sum(scaled[1:], scaled[0]) / len(scaled), 9))
    best = scored.groupBy("document_id").agg(F.min_by(F.struct("resolution", "seed", "score"), F.struct(-F.col("score"), "resolution", "seed")).alias("b"))
    docs = candidates.select("document_id").distinct().join(best, "document_id", "left")
    return docs.select("document_id", F.coalesce("b.resolution", F.lit(1.0)).alias("resolution"), F.coalesce("b.seed", F.lit(BASELINE_SEED)).alias("seed"), F.col("b.score").alias("score"))


def betweenness(n: int, adj: list[list[tuple[int, float]]], sources=None) -> np.ndarray:
    """Share of shortest paths through each node, or what paths from some sources add to it; the weight of an edge is its length."""
    out = np.zeros(n)
    for source in range(n) if sources is None else sources:
        dist, count, before = {source: 0.0}, {source: 1.0}, {source: []}
        heap, done, order = [(0.0, source)], set(), []
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            order.append(a)
            for b, w in adj[a]:
                x = d + w
                if b not in dist or x < dist[b] - 1e-12:
                    dist[b], count[b], before[b] = x, count[a], [a]
                    heapq.heappush(heap, (x, b))
                elif abs(x - dist[b]) <= 1e-12 and b not in done:
                    count[b] += count[a]
                    before[b].append(a)
        part = dict.fromkeys(order, 0.0)
        for a in reversed(order):
            for b in before[a]:
                part[b] += count[b] / count[a] * (1 + part[a])
            if a != source:
                out[a] += part[a]
    return out / ((n - 1) * (n - 2)) if n > 2 and sources is None else out


def betweenness_of_arcs(n: int, src: np.ndarray, dst: np.ndarray, ww: np.ndarray, sources: np.ndarray, cells: int | None = None) -> np.ndarray:
    """What ``betweenness`` adds up from some sources, for arcs in both directions that leave every node; a block of sources is searched at once.

    Distances of a block are rows of a table of single precision, a row for each node, which are lowered until none changes any more. An arc that
    is longer than the distance it bridges by more than single precision can hide is on no shortest path. The few that are left are taken in steps
    no longer than the lightest edge, so that a path has one node in a step; lengths in double precision decide which are on one. Sources near
    each other in turn make fewer rows change at a time.
    """
    order = np.lexsort((dst, src))
    src, dst, ww = src[order], dst[order], ww[order]
    if not n or not ww.min() > 1e-9:
        adj: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for p, q, s in zip(src.tolist(), dst.tolist(), ww.tolist()):
            adj[p].append((q, s))
        return betweenness(n, adj, [int(s) for s in sources])
    if cells is None:
        cells = max(700_000, min(32 * n, 32_000_000))
    degree = np.bincount(src, minlength=n)
    first = np.r_[0, np.cumsum(degree)[:-1]]
    # rows by falling degree: the k-th arcs of the nodes that have so many leave the first rows
    rows = np.argsort(-degree, kind="stable")
    at = np.empty(n, dtype=np.int64)
    at[rows] = np.arange(n)
    slots = []
    for k in range(int(degree.max())):
        arc = first[rows[degree[rows] > k]] + k
        slots.append((at[dst[arc]], ww[arc], ww[arc].astype(np.float32)[:, None]))
    out = np.zeros(n)
    block = max(1, cells // n)
    for k in range(0, len(sources), block):
        own = np.asarray(sources[k : k + block], dtype=np.int64)
        found = _from_block(n, slots, float(ww.min()), at[own])
        out += _by_rounds(n, src, dst, ww, own, cells) if found is None else found[at]
    return out


def _from_block(n: int, slots: list, least: float, own: np.ndarray) -> np.ndarray | None:
    """What the shortest paths from the rows ``own`` add to each row; nothing if paths have too many edges, or lengths are too unlike, for the steps."""
    dist = _lowered(n, slots, own)
    if dist is None:
        return None
    top = float(dist[np.isfinite(dist)].max())
    # each sum is wrong by half a unit in the last of 24 bits, at most, for every edge of a path and for the edge itself
    slack = 8 * (top / least + 3) * 2.0**-24 * top + 2e-12
    if slack > least / 40 or top / (least - 4 * slack) > STEPS - 1:
        return None
    out, some = np.zeros(n), max(1, CELLS // n)
    for k in range(0, len(own), some):
        out += _settled(n, slots, least, slack, own[k : k + some], np.ascontiguousarray(dist[:, k : k + some]))
    return out


def _settled(n: int, slots: list, least: float, slack: float, own: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """What ``_from_block`` gives, from distances that are right but for less than ``slack``."""
    m = len(own)
    # cell r * m + s is row r as seen from the s-th source
    a, b, w = [], [], []
    with np.errstate(invalid="ignore"):
        for to, ww, narrow in slots:
            for r in range(0, len(to), 4 * ROWS):
                x = np.take(dist, to[r : r + 4 * ROWS], axis=0, mode="clip")
                x += narrow[r : r + len(x)]
                x -= dist[r : r + len(x)]
                f = np.flatnonzero(x <= slack)
                q = f // m + r
                a.append(f + r * m)
                b.append((to[q] - q) * m + a[-1])
                w.append(ww[q])
    a, b, w = np.concatenate(a), np.concatenate(b), np.concatenate(w)
    step = (dist.ravel().take(a, mode="clip") * np.float32(1 / (least - 4 * slack))).astype(np.uint8)
    order = np.argsort(step, kind="stable")
    a, b, w = (x.take(order, mode="clip") for x in (a, b, w))
    ends = np.cumsum(np.bincount(step)).tolist()
    start = own * m + np.arange(m)
    far, count, part = np.full(n * m, np.inf), np.zeros(n * m), np.zeros(n * m)
    far[start], count[start] = 0.0, 1.0
    steps = []
    for p, q in zip([0, *ends], ends):
        if p == q:
            continue
        x, y = a[p:q], b[p:q]
        d = far.take(y, mode="clip") + w[p:q]
        far[x] = d
        other = far.take(x, mode="clip") != d
        if other.any():
            np.minimum.at(far, x[other], d[other])
            on = d - far.take(x, mode="clip") <= 1e-12
            x, y = x[on], y[on]
        ways = count.take(y, mode="clip")
        np.add.at(count, x, ways)
        steps.append((x, y, ways))
    for x, y, ways in reversed(steps):
        np.add.at(part, y, ways / count.take(x, mode="clip") * (1 + part.take(x, mode="clip")))
    part[start] = 0.0
    return part.reshape(n, m).sum(1)


def _lowered(n: int, slots: list, own: np.ndarray) -> np.ndarray | None:
    """Distances, in single precision, of all rows from the rows ``own``; nothing if paths have more edges than there are steps."""
    m = len(own)
    dist = np.full((n, m), np.inf, dtype=np.float32)
    dist[own, np.arange(m)] = 0.0
    space = np.empty((min(n, ROWS), m), dtype=np.float32)
    sizes = [len(to) for to, _, _ in slots]
    changed = np.zeros(n, dtype=bool)
    changed[own] = True
    for _ in range(STEPS + 1):
        touched = np.zeros(n, dtype=bool)
        for to, _, _ in slots:
            touched[: len(to)] |= changed[to]
        rows = np.flatnonzero(touched)
        changed[:] = False
        for k in range(0, len(rows), ROWS):
            r = rows[k : k + ROWS]
            was = dist[r]
            now = was.copy()
            for (to, _, narrow), e in zip(slots, np.searchsorted(r, sizes).tolist()):
                if not e:
                    break
                x = np.take(dist, to[r[:e]], axis=0, out=space[:e], mode="clip")
                x += narrow[r[:e]]
                np.minimum(now[:e], x, out=now[:e])
            changed[r] = (now < was).any(1)
            dist[r] = now
        if not changed.any():
            return dist
    return None


def _by_rounds(n: int, src: np.ndarray, dst: np.ndarray, ww: np.ndarray, sources: np.ndarray, cells: int) -> np.ndarray:
    """What ``betweenness_of_arcs`` gives, for arcs in order, however long the shortest paths are.

    In each round all nodes settle that are nearer than any open node and its lightest edge: no path can reach them any more. Paths are
    counted as nodes settle, and their shares go back round by round.
    """
    degree = np.bincount(src, minlength=n)
    first = np.r_[0, np.cumsum(degree)[:-1]]
    least = np.minimum.reduceat(ww, first)
    out = np.zeros(n)
    block = max(1, cells // n)
    for k in range(0, len(sources), block):
        own = np.asarray(sources[k : k + block], dtype=np.int64)
        m = len(own)
        # cell r * n + v is node v as seen from the r-th source
        start = np.arange(m) * n + own
        dist, count, part = np.full(m * n, np.inf), np.zeros(m * n), np.zeros(m * n)
        dist[start], count[start] = 0.0, 1.0
        mark, near, rounds = np.zeros(m * n, dtype=np.int64), start, []
        while len(near):
            row, d = near // n, dist[near]
            reach = np.full(m, np.inf)
            np.minimum.at(reach, row, d + least[near - row * n])
            settled = d < reach[row] - 2e-12
            v, near = near[settled], near[~settled]
            node = v % n
            many = degree[node]
            ends = np.cumsum(many)
            arc = np.arange(ends[-1]) + np.repeat(first[node] - ends + many, many)
            t, w, x = np.repeat(v - node, many) + dst[arc], ww[arc], np.repeat(dist[v], many)
            far = dist[t]
            came = np.abs(far + w - x) <= 1e-12
            a, b = np.repeat(v, many)[came], t[came]
            np.add.at(count, a, count[b])
            rounds.append((a, b))
            y = x + w
            closer = y < far
            t, y = t[closer], y[closer]
            fresh = t[np.isinf(far[closer])]
            np.minimum.at(dist, t, y)
            mark[fresh] = np.arange(len(fresh))
            near = np.r_[near, fresh[mark[fresh] == np.arange(len(fresh))]]
        for a, b in reversed(rounds):
            np.add.at(part, b, count[b] / count[a] * (1 + part[a]))
        part[start] = 0.0
        out += part.reshape(m, n).sum(0)
    return out


def _arcs(b: pd.DataFrame):
    m, w = len(b), b["sim"].to_numpy(dtype=float)
    ids, at = np.unique(np.concatenate([b["i"].to_numpy(), b["j"].to_numpy()]), return_inverse=True)
    return ids, at, np.r_[at[m:], at[:m]], np.r_[w, w]


def _packed(sources: int):
    """One row for a document: its edges as numbers, and its nodes in an order in which near ones follow each other."""

    def run(key, b):
        ids, src, dst, ww = _arcs(b)
        n, m = len(ids), len(b)
        arc = np.argsort(src, kind="stable")
        to, ends = dst[arc].tolist(), np.cumsum(np.bincount(src, minlength=n)).tolist()
        seen, order = bytearray(n), []
        for root in range(n):
            if not seen[root]:
                seen[root] = 1
                k = len(order)
                order.append(root)
                while k < len(order):
                    p = order[k]
                    for q in to[ends[p - 1] if p else 0 : ends[p]]:
                        if not seen[q]:
                            seen[q] = 1
                            order.append(q)
                    k += 1
        row = (key[0], min(TILES, -(-m // sources)), np.array(order, dtype=np.int32).tobytes(), src[:m].astype(np.int32).tobytes(), dst[:m].astype(np.int32).tobytes(), ww[:m].tobytes())
        return pd.DataFrame([row], columns=["document_id", "_tiles", "_order", "_i", "_j", "_w"])

    return run


def _between_tiles(batches):
    """What the shortest paths from the sources of each tile add to the nodes of its document."""
    for b in batches:
        for t in b.itertuples(index=False, name=None):
            doc, tiles, order, i, j, w, tile = t
            order, i, j = (np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in (order, i, j))
            w, n = np.frombuffer(w), len(order)
            own = order[tile * n // tiles : (tile + 1) * n // tiles]
            yield pd.DataFrame({"document_id": [doc], "_part": [betweenness_of_arcs(n, np.r_[i, j], np.r_[j, i], np.r_[w, w], own).tobytes()]})


def _added(key, b):
    out = sum(np.frombuffer(x) for x in b["_part"])
    return pd.DataFrame({"document_id": key[0], "_at": np.arange(len(out)), "_far": out})


def _central(doc, b: pd.DataFrame, paths: bool) -> dict:
    """Centralities of the nodes of a document, with what all shortest paths add to each if they are wanted."""
    ids, src, dst, ww = _arcs(b)
    n = len(ids)
    degree = np.bincount(src, minlength=n) / max(1, n - 1)
    strength = np.bincount(src, ww, n)
    eigen = np.full(n, 1.0 / n)
    for _ in range(500):
        last = eigen
        # shifted by the identity, so that bipartite graphs settle too
        eigen = last + np.bincount(dst, ww * last[src], n)
        eigen /= np.linalg.norm(eigen) or 1.0
        if np.abs(eigen - last).sum() < n * 1e-6:
            break
    else:
        eigen = np.zeros(n)
    rank = np.full(n, 1.0 / n)
    for _ in range(100):
        last = rank
        rank = 0.15 / n + 0.85 * np.bincount(dst, ww * (last / np.where(strength > 0, strength, 1))[src], n)
        if np.abs(rank - last).sum() < n * 1e-6:
            break
    between = betweenness_of_arcs(n, src, dst, ww, np.arange(n)) if paths else np.full(n, np.nan)
    return {"document_id": np.full(n, doc, dtype=object), "node": ids, "degree": degree, "eigenvector": eigen, "pagerank": rank, "_n": np.full(n, n), "_at": np.arange(n), "_near": between}


def _central_of_many(batches):
    for b, cuts in V.whole_groups(batches, "document_id"):
        docs = b["document_id"].to_numpy()
        parts = [_central(docs[p], b.iloc[p:q], True) for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        yield pd.DataFrame({c: np.concatenate([x[c] for x in parts]) for c in parts[0]})


def _central_of_one(key, b):
    return pd.DataFrame(_central(key[0], b, False))


def centralities(edges: DataFrame, sources: int = SOURCES) -> DataFrame:
    """Degree, betweenness, eigenvector and PageRank of the nodes of each document, their mean, and the rank by it.

    Documents of more than ``sources`` edges have their shortest paths searched in tiles of sources, dealt out evenly; the edges go to each tile as numbers.
    """
    edges = materialize(edges.select("document_id", "i", "j", "sim").where("document_id is not null"), "centrality-edges")
    large = edges.groupBy("document_id").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > sources).select("document_id")
    big = edges.join(large, "document_id", "left_semi")
    small = edges.join(large, "document_id", "left_anti").repartition("document_id").sortWithinPartitions("document_id")
    shape = "document_id string, node string, degree double, eigenvector double, pagerank double, _n bigint, _at bigint, _near double"
    c = small.mapInPandas(_central_of_many, shape).unionByName(big.groupBy("document_id").applyInPandas(_central_of_one, shape))
    packed = big.groupBy("document_id").applyInPandas(_packed(sources), "document_id string, _tiles int, _order binary, _i binary, _j binary, _w binary")
    tiles = packed.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).repartition(TILES)
    far = tiles.mapInPandas(_between_tiles, "document_id string, _part binary").groupBy("document_id").applyInPandas(_added, "document_id string, _at bigint, _far double")
    c = c.join(far, ["document_id", "_at"], "left").withColumn("_between", F.coalesce(F.when(~F.isnan("_near"), F.col("_near")), "_far"))
    pairs = (F.col("_n") - 1) * (F.col("_n") - 2)
    c = c.withColumn("betweenness", F.when(F.col("_n") > 2, F.col("_between") / pairs).otherwise(F.col("_between")))
    c = c.withColumn("composite_score", (F.col("degree") + F.col("betweenness") + F.col("eigenvector") + F.col("pagerank")) / 4)
    w = Window.partitionBy("document_id").orderBy(F.desc(F.round("composite_score", 9)), "node")
    return c.select("document_id", "node", "degree", "betweenness", "eigenvector", "pagerank", "composite_score", F.row_number().over(w).cast("bigint").alias("rank"))


def graph_summaries(nodes: DataFrame, top: int = 10, shown: int = 20) -> DataFrame:
    """(document_id, n_nodes, n_communities, top_nodes, largest) of nodes (document_id, node, degree, community): the nodes of most edges and the first
    members of the largest community, ties to the smaller name. The lists are the report's own limits; windows keep no more rows than that per partition."""
    order = [F.desc("degree"), "node"]
    whole = nodes.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("community").alias("n_communities"))
    first = lambda by, n: nodes.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "node"))), lambda x: x["node"]), ",").alias("_names"))
    size = nodes.groupBy("document_id", "community").agg(F.count(F.lit(1)).alias("_n")).groupBy("document_id").agg(F.min_by("community", F.struct(-F.col("_n"), "community")).alias("community"))
    most = first(["document_id", "community"], shown).join(size, ["document_id", "community"]).select("document_id", F.col("_names").alias("largest"))
    return whole.join(first(["document_id"], top).withColumnRenamed("_names", "top_nodes"), "document_id").join(most, "document_id")


def retrieved_view(components: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(node, component, retrieved) of the components (node, component) that hold a retrieved node."""
    marked = components.join(retrieved.select("node").distinct().withColumn("retrieved", F.lit(True)), "node", "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(False)))
    return marked.join(marked.where("retrieved").select("component").distinct(), "component", "left_semi").select("node", "component", "retrieved")
