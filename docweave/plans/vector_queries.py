"""Queries of retrieval, vectors and topology, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lifecycle as L
from ..operators import retrieval as R
from ..operators import vectors as V
from ..operators.components import connected_components
from ..sources.tables import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The neighbours of a node, the least similarity of the fixed policy, and the bounds of degrees. Fixed values.
KNN, FIXED_ABOVE, LEAST_DEGREE, MOST_DEGREE = 3, 0.3, 1, 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_USABLE = """usable as (select chunk_uid, document_id, point_id, embedding from points where vector_point and graph_control_point is null and graph_tombstoned is not true and len(embedding) = 64
   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
vec as (select chunk_uid, arg_min(document_id, point_id) as document_id, arg_min(embedding, point_id) as embedding from usable group by 1),
pairs as (select a.document_id, a.chunk_uid as i, b.chunk_uid as j, list_cosine_similarity(a.embedding, b.embedding) as sim from vec a join vec b on a.document_id = b.document_id and a.chunk_uid <> b.chunk_uid),
knn as (select document_id, i, j, row_number() over (partition by document_id, i order by round(sim, 9) desc, j)::bigint as rank, sim from pairs qualify row_number() over (partition by document_id, i order by round(sim, 9) desc, j) <= 3),
cutoff as (select document_id, count(*)::bigint as n_pairs, avg(sim) + 0.5 * stddev_pop(sim) as cutoff from pairs where i < j group by 1),
mutual as (select a.document_id, a.i, a.j, a.sim from knn a join knn b on a.document_id = b.document_id and a.i = b.j and a.j = b.i join cutoff c on a.document_id = c.document_id where a.i < a.j and a.sim >= c.cutoff)"""
_FIXED = _USABLE + ", fixed as (select distinct document_id, least(i, j) as i, greatest(i, j) as j, round(sim, 9) as sim from knn where sim > 0.3)"


def _vec(spark: SparkSession, root: str) -> DataFrame:
    return V.usable_points(read_table(spark, root, "points"))


def _knn(spark: SparkSession, root: str) -> DataFrame:
    return V.group_neighbours(_vec(spark, root), "document_id", "chunk_uid", KNN)


def _cutoff(spark: SparkSession, root: str) -> DataFrame:
    return V.pair_statistics(_vec(spark, root), "document_id").where("n_pairs > 0").select("document_id", "n_pairs", (F.col("mean") + 0.5 * F.col("std")).alias("cutoff"))


def _mutual(spark: SparkSession, root: str) -> DataFrame:
    m = V.mutual(_knn(spark, root), "document_id").join(_cutoff(spark, root), "document_id")
    # the cosine is rounded to 9 decimals, so is the cutoff it is held against
    return m.where(F.col("sim") >= F.round("cutoff", 9)).select("document_id", "i", "j", "sim")


def _fixed(spark: SparkSession, root: str) -> DataFrame:
    return V.either(_knn(spark, root), "document_id", FIXED_ABOVE)


@query("""with q as (select embedding::double[] as e from embeddings where vec_id = 0), s as (select vec_id, label, list_cosine_similarity(embedding::double[], q.e) as score from embeddings, q where vec_id <> 0 and label in (0, 1, 2, 3, 4))
  select vec_id, label, round(score, 6) as score, row_number() over (order by score desc, vec_id)::bigint as rank from s order by score desc, vec_id limit 10""")
def t1_topk_cosine(spark: SparkSession, root: str) -> DataFrame:
    e = read_table(spark, root, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").cast("array<double>")).first()
    best = V.top_k(e.where("vec_id <> 0 and label in (0, 1, 2, 3, 4)"), q[0] if q else [], 10, "vec_id")
    return best.select("vec_id", "label", F.round("score", 6).alias("score"), "rank")


@query("""select p.point_id, p.document_id, p.document_generation from points p where vector_point and graph_control_point is null and coalesce(graph_tombstoned, false) = false and coalesce(graph_point, false) = false
  and exists (select 1 from document_entries e where e.document_id = p.document_id and e.document_generation = p.document_generation and e.status = 'available')
  and not exists (select 1 from document_entries e where e.document_id = p.document_id and e.status = 'tombstoned')""")
def f4_visible_points(spark: SparkSession, root: str) -> DataFrame:
    e = read_table(spark, root, "document_entries")
    return R.visible(read_table(spark, root, "points"), e.where("status = 'available'"), e.where("status = 'tombstoned'")).select("point_id", "document_id", "document_generation")


@query("""select point_id, coalesce(nullif(chunk_uid, ''), document_id || ':chunk:' || chunk_id) as chunk_uid, coalesce(level, 'paragraph') as level, coalesce(source, 'docling') as source, page_no, image_url from points""")
def f1_payloads(spark: SparkSession, root: str) -> DataFrame:
    return R.normal_payload(read_table(spark, root, "points"))


@query("select coalesce(document_id, '') = '' as legacy, count(*) as n from points where graph_control_point is null group by 1")
def f7_legacy_rows(spark: SparkSession, root: str) -> DataFrame:
    p = read_table(spark, root, "points").where("graph_control_point is null")
    return p.groupBy((F.coalesce("document_id", F.lit("")) == "").alias("legacy")).agg(F.count(F.lit(1)).alias("n"))


@query("""with v as (select document_id, coalesce(len(embedding), 0) > 0 and len(list_filter(coalesce(embedding, []), lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(coalesce(embedding, []), lambda x: x <> 0)) > 0 as ok, len(embedding) as dim from points where graph_control_point is null)
  select document_id, count(*) as n, count(*) filter (ok) as n_valid, count(distinct dim) filter (ok) as n_dims, (bool_and(ok) and count(distinct dim) filter (ok) = 1) as uniform from v group by 1""")
def f15_vector_validity(spark: SparkSession, root: str) -> DataFrame:
    p = read_table(spark, root, "points").where("graph_control_point is null").select("document_id", V.valid_vector(F.col("embedding")).alias("ok"), F.size("embedding").alias("dim"))
    g = p.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_valid"), F.countDistinct(F.when(F.col("ok"), F.col("dim"))).alias("n_dims"), F.every("ok").alias("_all"))
    return g.select("document_id", "n", "n_valid", "n_dims", (F.col("_all") & (F.col("n_dims") == 1)).alias("uniform"))


@query("select document_id, count(*) as n, count(*) > 0 as present from points where vector_point and document_id is not null group by 1")
def a1_filtered_counts(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "points").where("vector_point and document_id is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).withColumn("present", F.col("n") > 0)


# the batch that comes in is a new generation of the documents that are not available
@query("""with n as (select point_id, 1 as batch, document_generation + 1 as generation from points where document_id in (select document_id from document_entries where status <> 'available')), u as (select point_id, 0 as batch, document_generation as generation from points union all select * from n)
  select point_id, max(batch) as batch, arg_max(generation, batch) as generation from u group by 1""")
def s9_upserted(spark: SparkSession, root: str) -> DataFrame:
    p = read_table(spark, root, "points").select("point_id", "document_id", "document_generation")
    due = read_table(spark, root, "document_entries").where("status <> 'available'").select("document_id")
    old = p.select("point_id", F.lit(0).alias("batch"), F.col("document_generation").alias("generation"))
    new = p.join(due, "document_id", "left_semi").select("point_id", F.lit(1).alias("batch"), (F.col("document_generation") + 1).alias("generation"))
    return R.upsert(old, new, ["point_id"], "batch").select("point_id", "batch", "generation")


@query("select p.point_id from points p where not exists (select 1 from document_entries e where e.document_id = p.document_id and e.status in ('tombstoned', 'stale'))")
def s11_deleted(spark: SparkSession, root: str) -> DataFrame:
    gone = read_table(spark, root, "document_entries").where("status in ('tombstoned', 'stale')").select("document_id")
    return read_table(spark, root, "points").join(gone, "document_id", "left_anti").select("point_id")


@query("""select p.point_id from points p join document_entries e on p.document_id = e.document_id where p.graph_control_point is null and p.document_generation < e.document_generation + (e.pending_version is not null)::int""")
def j16_stale_points(spark: SparkSession, root: str) -> DataFrame:
    return R.stale(read_table(spark, root, "points"), L.once_published(read_table(spark, root, "document_entries"))).select("point_id")


@query("""with r as (select source_point_id, chunk_uid, point_id, document_attempt_id, count(*) over w as n, row_number() over (partition by source_point_id, chunk_uid order by (p.document_attempt_id = e.document_attempt_id) desc nulls last, (p.source_point_id is null) desc, point_id) as k
    from points p left join (select document_id, document_attempt_id from document_entries) e using (document_id) where p.vector_point window w as (partition by source_point_id, chunk_uid))
  select chunk_uid, point_id, n::bigint as n_candidates from r where k = 1""".replace("document_attempt_id, count", "p.document_attempt_id, count"))
def j18_canonical_records(spark: SparkSession, root: str) -> DataFrame:
    return R.canonical_records(read_table(spark, root, "points"), read_table(spark, root, "document_entries"))


@query("select document_id, count(*) as n, sha256(string_agg(point_id, ',' order by point_id)) as digest from points where vector_point group by 1")
def a16_point_set_digests(spark: SparkSession, root: str) -> DataFrame:
    return R.point_set_digest(read_table(spark, root, "points").where("vector_point"))


@query(f"with {_USABLE} select document_id, n_pairs, round(cutoff, 6) as cutoff from cutoff")
def a2_similarity_cutoff(spark: SparkSession, root: str) -> DataFrame:
    return _cutoff(spark, root).select("document_id", "n_pairs", F.round("cutoff", 6).alias("cutoff"))


@query(f"with {_USABLE} select document_id, i, j, rank, round(round(sim, 9), 6) as sim from knn")
def w3_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return _knn(spark, root).withColumn("sim", F.round("sim", 6))


@query(f"with {_USABLE} select document_id, i, j, round(round(sim, 9), 6) as sim from mutual")
def j5_mutual_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return _mutual(spark, root).withColumn("sim", F.round("sim", 6))


@query(f"with {_FIXED} select document_id, i, j, round(sim, 6) as sim from fixed")
def w4_fixed_topology(spark: SparkSession, root: str) -> DataFrame:
    return _fixed(spark, root).withColumn("sim", F.round("sim", 6))


@query(f"with {_USABLE} select document_id, count(*)::bigint as n, round(avg(sim), 6) as coherence from pairs where i < j group by 1")
def a11_coherence(spark: SparkSession, root: str) -> DataFrame:
    return V.pair_statistics(_vec(spark, root), "document_id").where("n_pairs > 0").select("document_id", F.col("n_pairs").alias("n"), F.round("mean", 6).alias("coherence"))


@query(f"""with recursive {_FIXED}, e as (select i as a, j as b from fixed union all select j, i from fixed),
  reach(node, other) as (select a, a from e union select r.node, e.b from reach r join e on r.other = e.a) select node, min(other) as component from reach group by 1""")
def g5_components(spark: SparkSession, root: str) -> DataFrame:
    return connected_components(_fixed(spark, root), "i", "j")


@query(f"""with {_FIXED}, d as (select document_id, node, count(*) as degree from (select document_id, i as node from fixed union all select document_id, j from fixed) group by 1, 2),
  n as (select document_id, count(*) as nodes from vec group by 1), e as (select document_id, count(*) as edges from fixed group by 1), m as (select document_id, count(*) as with_edge, max(degree) as most, count(*) filter (degree >= 5) as at_most from d group by 1)
  select n.document_id, n.nodes::bigint as nodes, coalesce(edges, 0)::bigint as edges, (nodes - coalesce(with_edge, 0))::bigint as orphans, coalesce(most, 0)::bigint as most_degree, coalesce(at_most, 0)::bigint as at_most, round(case when nodes > 1 then 2.0::double * coalesce(edges, 0) / (nodes * (nodes - 1)) else 0 end, 6) as density from n left join e using (document_id) left join m using (document_id)""")
def a8_topology_metrics(spark: SparkSession, root: str) -> DataFrame:
    return G.topology_metrics(_vec(spark, root).select("document_id", F.col("chunk_uid").alias("node")), _fixed(spark, root), MOST_DEGREE)


@query(f"""with {_FIXED}, d as (select document_id, node, count(*) as degree from (select document_id, i as node from fixed union all select document_id, j from fixed) group by 1, 2), n as (select document_id, count(*) as nodes from vec group by 1)
  select v.document_id, v.chunk_uid as node, coalesce(degree, 0)::bigint as degree, round(case when nodes > 1 then coalesce(degree, 0)::double / (nodes - 1) else 0 end, 6) as centrality from vec v join n using (document_id) left join d on d.document_id = v.document_id and d.node = v.chunk_uid""")
def g12_degree_centrality(spark: SparkSession, root: str) -> DataFrame:
    return G.degree_centrality(_vec(spark, root).select("document_id", F.col("chunk_uid").alias("node")), _fixed(spark, root)).withColumn("centrality", F.round("centrality", 6))


_PART = "p as (select chunk_uid as node, (chunk_id % 3)::bigint as community from (select distinct chunk_uid, chunk_id from points))"


@query(f"""with {_FIXED}, {_PART}, e as (select f.*, a.community as ca, b.community as cb from fixed f join p a on a.node = f.i join p b on b.node = f.j),
  m as (select document_id, sum(sim) as m from e group by 1), s as (select document_id, community, sum(w) as deg from (select document_id, ca as community, sim as w from e union all select document_id, cb, sim from e) group by 1, 2),
  i as (select document_id, ca as community, sum(sim) as inner_w from e where ca = cb group by 1, 2)
  select document_id, round(sum(coalesce(inner_w, 0) / m - power(deg / (2 * m), 2)), 6) as modularity from s join m using (document_id) left join i using (document_id, community) group by 1""")
def a10_modularity(spark: SparkSession, root: str) -> DataFrame:
    part = read_table(spark, root, "points").select(F.col("chunk_uid").alias("node"), (F.col("chunk_id") % 3).alias("community")).distinct()
    return G.modularity(_fixed(spark, root), part).withColumn("modularity", F.round("modularity", 6))


@query("""with t as (select label::bigint as a, (vec_id % 5)::bigint as b from embeddings), c as (select a, b, count(*)::double as n from t group by 1, 2), ra as (select a, sum(n) as n from c group by 1), rb as (select b, sum(n) as n from c group by 1), tot as (select sum(n) as n from c),
  s as (select (select sum(n * (n - 1) / 2) from c) as ij, (select sum(n * (n - 1) / 2) from ra) as i, (select sum(n * (n - 1) / 2) from rb) as j, (select n * (n - 1) / 2 from tot) as all_,
    (select sum(c.n / tot.n * ln(c.n * tot.n / (ra.n * rb.n))) from c join ra using (a) join rb using (b), tot) as mi, (select -sum(ra.n / tot.n * ln(ra.n / tot.n)) from ra, tot) as ha, (select -sum(rb.n / tot.n * ln(rb.n / tot.n)) from rb, tot) as hb)
  select round((ij - i * j / all_) / ((i + j) / 2 - i * j / all_), 6) as ari, round(mi / ((ha + hb) / 2), 6) as nmi from s""")
def a12_partition_agreement(spark: SparkSession, root: str) -> DataFrame:
    e = read_table(spark, root, "embeddings")
    r = G.partition_agreement(e, F.col("label").cast("bigint"), (F.col("vec_id") % 5).cast("bigint"))
    return r.select(F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"))


_RANKS = _FIXED + """, arcs as (select document_id, i as src, j as dst, sim from fixed union all select document_id, j, i, sim from fixed), outs as (select document_id, src, sum(sim) as w from arcs group by 1, 2),
share as (select a.document_id, a.src, a.dst, a.sim / o.w as share from arcs a join outs o on a.document_id = o.document_id and a.src = o.src), ns as (select document_id, src as node, count(*) over (partition by document_id) as n from (select distinct document_id, src from share)),
r0 as (select document_id, node, 1.0::double / n as r from ns)""" + "".join(f""",
r{k + 1} as (select ns.document_id, ns.node, 0.15::double / ns.n + 0.85::double * coalesce(c.r, 0) as r from ns left join (select s.document_id, s.dst as node, sum(x.r * s.share) as r from share s join r{k} x on x.document_id = s.document_id and x.node = s.src group by 1, 2) c on c.document_id = ns.document_id and c.node = ns.node)""" for k in range(10))


@query(f"with {_RANKS} select document_id, node, round(r, 9) as pagerank from r10")
def g15_pagerank(spark: SparkSession, root: str) -> DataFrame:
    return G.pagerank(_fixed(spark, root), rounds=10).withColumn("pagerank", F.round("pagerank", 9))


@query()
def g2_adaptive_topology(spark: SparkSession, root: str) -> DataFrame:
    return G.adaptive_topology(_vec(spark, root), KNN, FIXED_ABOVE, LEAST_DEGREE, MOST_DEGREE)


@query()
def g7_communities(spark: SparkSession, root: str) -> DataFrame:
    return G.communities(_fixed(spark, root))


@query()
def g8_selected_communities(spark: SparkSession, root: str) -> DataFrame:
    return G.select_communities(G.community_candidates(_fixed(spark, root)), _fixed(spark, root), _vec(spark, root))


@query()
def g13_centralities(spark: SparkSession, root: str) -> DataFrame:
    return G.centralities(_fixed(spark, root))


@query(f"""with {_FIXED}, n as (select document_id, chunk_uid as node, coalesce((select sum(sim) from fixed f where f.document_id = v.document_id and (f.i = v.chunk_uid or f.j = v.chunk_uid)), 0) as strength from vec v)
  select document_id, node, round(case when max(strength) over w > 0 then greatest(strength, 0) / max(strength) over w else 0 end, 6) as normalised from n window w as (partition by document_id)""")
def a14_normalised_strength(spark: SparkSession, root: str) -> DataFrame:
    nodes = _vec(spark, root).select("document_id", F.col("chunk_uid").alias("node"))
    s = G.strengths(_fixed(spark, root))
    w = Window.partitionBy("document_id")
    n = nodes.join(s, ["document_id", "node"], "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))
    most = F.max("strength").over(w)
    return n.select("document_id", "node", F.round(F.when(most > 0, F.greatest("strength", F.lit(0.0)) / most).otherwise(0.0), 6).alias("normalised"))
