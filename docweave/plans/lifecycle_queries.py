"""Queries of versions, claims, proofs, summaries of graphs and windows of evidence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import lifecycle as L
from ..operators import retrieval as R
from ..operators import summarize as S
from ..operators.components import connected_components
from ..sources.tables import read_table
from .context_queries import _PAIRS, _VOC, _pairs
from .evidence_queries import _EVIDENCE, _NEAR, _SUPPORT, _CANON
from .vector_queries import _FIXED, _fixed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_REQUESTS = """requests as (select e.document_id, coalesce(h.op, 'op-' || substr(md5(e.document_id), 1, 8)) as operation_id, case when e.document_generation % 2 = 0 then 'append' else 'replace-document' end as mode
  from document_entries e left join (select document_id, min(operation_id) as op from version_ledger where state = 'reserved' and version % 2 = 0 group by 1) h using (document_id)
  union all select document_id || ':new', 'op-new', 'append' from document_entries)"""


def _requests(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requests for every document there is, some by the operation that holds it, and for as many new ones."""
    held = ledger.where("state = 'reserved' and version % 2 = 0").groupBy("document_id").agg(F.min("operation_id").alias("op"))
    mode = F.when(F.col("document_generation") % 2 == 0, "append").otherwise("replace-document")
    old = entries.join(held, "document_id", "left").select("document_id", F.coalesce("op", F.concat(F.lit("op-"), F.substring(F.md5("document_id"), 1, 8))).alias("operation_id"), mode.alias("mode"))
    return old.unionByName(entries.select(F.concat("document_id", F.lit(":new")).alias("document_id"), F.lit("op-new").alias("operation_id"), F.lit("append").alias("mode")))


@query(f"""with {_REQUESTS}, top as (select document_id, max(version) as t from version_ledger where version is not null group by 1), o as (select distinct document_id, version, operation_id as held from version_ledger where state = 'reserved'),
  r as (select q.*, e.document_id is not null as known, e.pending_version, e.document_generation as g, e.document_fence_token as f, t.t from requests q left join document_entries e using (document_id) left join top t using (document_id)),
  h as (select r.document_id, bool_or(o.held = r.operation_id and o.version = r.pending_version) as mine, count_if(o.held <> r.operation_id) as others from r join o using (document_id) group by 1),
  x as (select r.*, h.others, case when h.mine then 'resumed' when mode = 'append' and known then 'refused' else 'reserved' end as outcome from r left join h using (document_id))
  select document_id, outcome, (case outcome when 'resumed' then pending_version when 'reserved' then coalesce(t, 0) + 1 end)::int as version, (case outcome when 'resumed' then g when 'reserved' then coalesce(g, 0) + 1 end)::int as document_generation,
    (case outcome when 'resumed' then f when 'reserved' then coalesce(f, 0) + 1 end)::int as fence_token, (case outcome when 'reserved' then coalesce(others, 0) else 0 end)::bigint as n_burned from x""")
def l4_reservations(spark: SparkSession, root: str) -> DataFrame:
    e, v = read_table(spark, root, "document_entries"), read_table(spark, root, "version_ledger")
    return L.reservations(e, v, _requests(e, v))


@query("""select distinct v.document_id, v.version, v.operation_id, v.state, case when v.version = e.pending_version then 'published_available' when v.version = e.active_version and v.state = 'published_available' then 'retired' else v.state end as new_state
  from version_ledger v join document_entries e using (document_id) where e.pending_version is not null and e.vector_ready and e.status = 'pending'""")
def l5_published(spark: SparkSession, root: str) -> DataFrame:
    return L.published(read_table(spark, root, "document_entries"), read_table(spark, root, "version_ledger")).distinct()


@query("""with n as (select document_id, count(*) as n from (select distinct document_id, version, operation_id from version_ledger where state = 'reserved') group by 1)
  select e.document_id, status, case when active_artifact_key is not null then 'partial' else 'unavailable' end as new_status, coalesce(n, 0)::bigint as n_failed from document_entries e left join n using (document_id) where status = 'pending'""")
def l6_failed(spark: SparkSession, root: str) -> DataFrame:
    return L.failed(read_table(spark, root, "document_entries"), read_table(spark, root, "version_ledger"))


@query("""with h as (select document_id, count_if(graph_control_point is null) as n_points, count_if(graph_control_point = 'tombstone') as n_controls from points group by 1)
  select e.document_id, coalesce(n_points, 0)::bigint as n_points, coalesce(n_controls, 0)::bigint as n_controls, sha256(e.document_id || '|' || coalesce(document_generation::varchar, '') || '|' || coalesce(document_attempt_id, '') || '|' || coalesce(document_fence_token::varchar, '')) as proof
  from document_entries e left join h using (document_id) where status = 'tombstoned'""")
def l7_denials(spark: SparkSession, root: str) -> DataFrame:
    return L.denials(read_table(spark, root, "points"), read_table(spark, root, "document_entries"))


@query("""with l as (select document_id, version, max(document_generation) as g from version_ledger where version is not null group by 1, 2),
  a as (select e.document_id, case when status = 'tombstoned' then null when status = 'pending' then l.g when status in ('partial', 'unavailable', 'stale') and not coalesce(vector_ready, false) then null else document_generation end as g from document_entries e left join l on l.document_id = e.document_id and l.version = e.active_version)
  select p.document_id, count(*) as n from points p join a on a.document_id = p.document_id and a.g = p.document_generation join document_entries e on e.document_id = p.document_id where vector_point and graph_control_point is null and graph_tombstoned is not true and e.failure_reason is null group by 1""")
def l11_authorised(spark: SparkSession, root: str) -> DataFrame:
    """The documents with a failure stand for those whose entry changed while a search ran."""
    e = read_table(spark, root, "document_entries")
    after = e.withColumn("document_fence_token", F.when(F.col("failure_reason").isNotNull(), F.coalesce("document_fence_token", F.lit(0)) + 1).otherwise(F.col("document_fence_token")))
    return L.authorised(read_table(spark, root, "points"), e, read_table(spark, root, "version_ledger"), after).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("""select v.document_id, v.version, bool_or(v.attempt_id is not distinct from e.document_attempt_id and v.document_generation is not distinct from e.document_generation and (v.version is not distinct from e.active_version or v.version is not distinct from e.pending_version)) as same
  from version_ledger v join document_entries e using (document_id) group by 1, 2""")
def n17_claims(spark: SparkSession, root: str) -> DataFrame:
    return L.claims(read_table(spark, root, "document_entries"), read_table(spark, root, "version_ledger"))


@query("""with v as (select document_id, coalesce(document_generation, -1) as g, coalesce(len(embedding), -1) as n, coalesce(len(list_filter(embedding, lambda x: x is null or not isfinite(x))) > 0, true) as bad from points where vector_point)
  select document_id, count(*) as n, count(distinct g) as n_generations, count(distinct n) as n_sizes, count(distinct g) = 1 and count(distinct n) = 1 and not bool_or(bad) as valid from v group by 1""")
def a17_backfill_groups(spark: SparkSession, root: str) -> DataFrame:
    return L.backfill_groups(read_table(spark, root, "points"))


@query(f"""with {_FIXED}, d as (select document_id, node, count(*) as degree from (select document_id, i as node from fixed union all select document_id, j from fixed) group by 1, 2), s as (select chunk_uid as node, max(coalesce(hierarchy.section_id, '')) as community from chunks group by 1),
  m as (select d.*, coalesce(s.community, '') as community from d left join s using (node)), r as (select *, row_number() over (partition by document_id order by degree desc, node) as k, row_number() over (partition by document_id, community order by degree desc, node) as c from m),
  g as (select document_id, community, count(*) as n, string_agg(node, ',' order by c) filter (where c <= 20) as members from r group by 1, 2)
  select document_id, count(*) as n_nodes, count(distinct community) as n_communities, string_agg(node, ',' order by k) filter (where k <= 10) as top_nodes, (select arg_min(members, [lpad((1000000000 - n)::varchar, 12, '0'), community]) from g where g.document_id = r.document_id) as largest from r group by 1""")
def a20_graph_summaries(spark: SparkSession, root: str) -> DataFrame:
    s = read_table(spark, root, "chunks").groupBy(F.col("chunk_uid").alias("node")).agg(F.max(F.coalesce("hierarchy.section_id", F.lit(""))).alias("community"))
    return G.graph_summaries(G.degrees(_fixed(spark, root)).join(s, "node", "left").withColumn("community", F.coalesce("community", F.lit(""))))


_WINDOWS = f"""{_NEAR}, {_SUPPORT[len(_CANON) + 2:]}, ent as (select document_id, chunk_uid, canonical, min(label) as label from canon group by 1, 2, 3),
  weak as (select distinct e.document_id, e.chunk_uid from ent e join support s on e.document_id = s.document_id and e.canonical = s.canonical where s.support <> 'strongly_supported'),
  p as (select n.document_id, n.a, n.b, l.canonical as l, r.canonical as r from near n join ent l on l.document_id = n.document_id and l.chunk_uid = n.a join ent r on r.document_id = n.document_id and r.chunk_uid = n.b and r.label = l.label and r.canonical <> l.canonical
    where exists (select 1 from weak w where w.document_id = n.document_id and (w.chunk_uid = n.a or w.chunk_uid = n.b)) qualify row_number() over (partition by n.document_id, n.a, n.b order by l.canonical, r.canonical) <= 16),
  sup as (select distinct document_id, least(l, r) as head, greatest(l, r) as tail, unnest([a, b]) as u from p),
  sides as (select document_id, i as u, j as v from fixed union all select document_id, j, i from fixed),
  nb as (select distinct s.document_id, s.head, s.tail, e.v as u from sup s join sides e on e.document_id = s.document_id and e.u = s.u), allu as (select *, 0 as far from sup union all select n.*, 1 from nb n anti join sup s using (document_id, head, tail, u)),
  ranked as (select *, row_number() over (partition by document_id, head, tail order by far, u) as k from allu), win as (select * from ranked where far = 0 or k <= 8),
  tx as (select chunk_uid as u, max(text) as t from chunks where text is not null group by 1),
  rl as (select distinct w.document_id, w.head, w.tail, x.head as h, x.relation as r, x.tail as t from win w join (select document_id, head, relation, tail, unnest(support_chunk_uids) as u from evidence) x on x.document_id = w.document_id and x.u = w.u),
  nr as (select document_id, head, tail, least(count(*), 8) as n_relations from rl group by 1, 2, 3)"""


@query(f"with {_WINDOWS} select w.document_id, w.head, w.tail, count(*) as n_chunks, sum(length(left(coalesce(t, ''), 600)))::bigint as n_chars, coalesce(max(n_relations), 0)::bigint as n_relations from win w left join tx using (u) left join nr using (document_id, head, tail) group by 1, 2, 3")
def t4_evidence_windows(spark: SparkSession, root: str) -> DataFrame:
    m, e = read_table(spark, root, "mentions"), E.normal_evidence(read_table(spark, root, "relation_evidence"))
    chunks, fixed = read_table(spark, root, "chunks"), _fixed(spark, root)
    c = E.recovery_support(E.neighbourhoods(chunks, m, fixed), m, E.entity_support(m, e))
    return E.evidence_windows(c, chunks, fixed, e).select("document_id", "head", "tail", "n_chunks", "n_chars", "n_relations")


@query("""with m as (select chunk_uid, lower(trim(text)) as name, min(coalesce(start_char, 2147483647)) as pos from mentions where trim(text) <> '' group by 1, 2), r as (select *, row_number() over (partition by chunk_uid order by pos, name) as k, count(*) over (partition by chunk_uid) as n from m)
  select chunk_uid, max(n)::bigint as n_entities, string_agg(name, '; ' order by k) filter (where k <= 20) as asked, 8 as most_relations from r group by 1 having max(n) >= 2""")
def t5_relation_requests(spark: SparkSession, root: str) -> DataFrame:
    return E.relation_requests(read_table(spark, root, "mentions"))


@query(f"""with {_EVIDENCE}, l as (select document_id, lower(head) as head, lower(relation) as relation, lower(tail) as tail, 'local' as origin from evidence where lower(source) <> 'recovery'), r as (select document_id, lower(head), lower(relation), lower(tail), 'recovered' from evidence where lower(source) = 'recovery' and status = 'accepted'),
  u as (select * from l union all select * from r) select document_id, head, relation, tail, count(*) as n, bool_or(origin = 'recovered') as recovered from u group by 1, 2, 3, 4""")
def u1_united_evidence(spark: SparkSession, root: str) -> DataFrame:
    e = E.normal_evidence(read_table(spark, root, "relation_evidence"))
    return E.united(e.where("lower(source) <> 'recovery'"), e.where("lower(source) = 'recovery' and status = 'accepted'"))


@query("""select p.document_id, p.point_id from points p anti join (select distinct chunk_uid from chunks where score is not null and not isnan(score)) k on k.chunk_uid = p.chunk_uid where p.graph_control_point is null""")
def u4_stale_points(spark: SparkSession, root: str) -> DataFrame:
    """What goes if only the retrieved chunks are kept."""
    keep = read_table(spark, root, "chunks").where("score is not null and not isnan(score)").select("chunk_uid").distinct()
    return R.difference(read_table(spark, root, "points").where("graph_control_point is null"), keep, "chunk_uid").select("document_id", "point_id")


@query(f"""with {_PAIRS}, v as (select s.id, {_VOC.format('summary')} as v, {_VOC.format('source')} as sv from summ s join js using (id)), o as (select id, case when len(v) > 0 then len(list_intersect(v, sv))::double / len(v) else 0 end as o from v)
  select id, o >= 0.30::double as passed, case when o >= 0.30::double then 'Quality check passed' else 'Lexical overlap below threshold' end as reason from o""")
def e18_simple_decisions(spark: SparkSession, root: str) -> DataFrame:
    return V.simple_decision(V.overlap_metrics(*_pairs(spark, root))).select("id", "passed", "reason")


@query("""with s as (select document_id, coalesce(hierarchy.section_id, '') as community, max(left(text, 200)) as summary from chunks where lower(level) = 'paragraph' and text is not null group by 1, 2), g as (select document_id as scope, count(*) as n, string_agg('[Community ' || community || ']' || chr(10) || trim(summary, ' '), chr(10) || chr(10) order by community) as b from s where trim(summary, ' ') <> '' group by 1)
  select scope, style, n, sha256(task || chr(10) || chr(10) || b) as digest from g, (values """ + ", ".join(f"('{k}', '{v}')" for k, v in S.REDUCE_STYLES.items()) + ") as t(style, task)")
def n16_reduce_prompts(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "chunks").where("lower(level) = 'paragraph' and text is not null").groupBy(F.col("document_id").alias("scope"), F.coalesce("hierarchy.section_id", F.lit("")).alias("community")).agg(F.max(F.substring("text", 1, 200)).alias("summary"))
    return S.reduce_prompts(c).select("scope", "style", "n", F.sha2("prompt", 256).alias("digest"))


@query(f"""with recursive {_FIXED}, e as (select i as a, j as b from fixed union all select j, i from fixed), reach(node, other) as (select a, a from e union select r.node, e.b from reach r join e on r.other = e.a), comp as (select node, min(other) as component from reach group by 1),
  got as (select distinct chunk_uid from chunks where score is not null and not isnan(score)), keep as (select distinct component from comp join got on got.chunk_uid = comp.node)
  select node, component, node in (select chunk_uid from got) as retrieved from comp where component in (select component from keep)""")
def j11_retrieved_view(spark: SparkSession, root: str) -> DataFrame:
    got = read_table(spark, root, "chunks").where("score is not null and not isnan(score)").select(F.col("chunk_uid").alias("node")).distinct()
    return G.retrieved_view(connected_components(_fixed(spark, root).select(F.col("i").alias("src"), F.col("j").alias("dst"))), got)


@query("""select distinct chunk_uid, coalesce(chunk_id, 0) as sort_key, array_to_string(list_sort(list_distinct(list_filter([image_url, source], lambda x: x is not null and x <> ''))), ' ') as places from chunks""")
def n1_canonical_sources(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "chunks")
    places = F.array_sort(F.array_distinct(F.filter(F.array("image_url", "source"), lambda x: x.isNotNull() & (x != ""))))
    return c.select("chunk_uid", F.coalesce("chunk_id", F.lit(0)).cast("bigint").alias("sort_key"), F.array_join(places, " ").alias("places")).distinct()


@query("""with k as (select distinct chunk_uid, document_id, chunk_id from chunks), n as (select 'chunk_' || chunk_id as node, document_id from k where chunk_id is not null and document_id is not null union select chunk_uid, document_id from k union select 'chunk_' || chunk_uid, null from k),
  a as (select n.node, n.document_id, k.chunk_uid, 1 as step from n join k on k.chunk_uid = n.node union all select n.node, n.document_id, k.chunk_uid, 2 from n join k on n.node = 'chunk_' || k.chunk_uid union all select n.node, n.document_id, k.chunk_uid, 3 from n join k on n.node = 'chunk_' || k.chunk_id and (n.document_id is null or n.document_id = k.document_id)),
  g as (select node, document_id, step, min(chunk_uid) as chunk_uid, count(distinct chunk_uid) as c from a group by 1, 2, 3)
  select node, document_id, chunk_uid from g where c = 1 qualify row_number() over (partition by node, document_id order by step) = 1""")
def n4_graph_chunks(spark: SparkSession, root: str) -> DataFrame:
    k = read_table(spark, root, "chunks").select("chunk_uid", "document_id", "chunk_id").distinct()
    nodes = k.where("chunk_id is not null and document_id is not null").select(F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string")).alias("node"), "document_id").union(k.select("chunk_uid", "document_id")).union(k.select(F.concat(F.lit("chunk_"), "chunk_uid"), F.lit(None).cast("string"))).distinct()
    return R.graph_chunks(nodes, k)


@query()
def t3_capped_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Recovery candidates within the caps per pair of chunks, entity, chunk and document, and those turned away with the cap that did it."""
    m = read_table(spark, root, "mentions")
    c = E.capped_candidates(E.neighbourhoods(read_table(spark, root, "chunks"), m, _fixed(spark, root)), m, E.entity_support(m, E.normal_evidence(read_table(spark, root, "relation_evidence"))))
    order = Window.partitionBy("document_id").orderBy(F.col("reason").isNotNull(), "head", "tail", "support_chunk_uids")
    return c.select("document_id", F.row_number().over(order).alias("place"), "head", "tail", F.size("support_chunk_uids").alias("n_support"), "reason")


@query()
def e1_extracted_entities(spark: SparkSession, root: str) -> DataFrame:
    """The named-like words of each sentence of each chunk: the extractor where no model is plugged in."""
    c = read_table(spark, root, "chunks").where("text is not null").select("chunk_uid", "text").distinct()
    return E.extracted_entities(c)
