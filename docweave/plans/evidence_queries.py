"""Queries of entities, evidence and recovery, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..sources.tables import read_table
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


_CLEAN = "regexp_replace(regexp_replace(trim(text), '\\s+', ' ', 'g'), '^[ ,.;:()\\[\\]{}]+|[ ,.;:()\\[\\]{}]+$', '', 'g')"
_VALID = f"""cleaned as (select *, {_CLEAN} as entity from mentions),
valid as (select * from cleaned where length(entity) > 2 and lower(trim(entity)) not in ('{"', '".join(T.STOP_ENTITIES)}') and not regexp_matches(entity, '^(19|20)\\d{{2}}$') and not regexp_matches(entity, '^[0-9]+$')
  and not regexp_matches(entity, '^[^\\p{{L}}\\p{{N}}]+$') and label in ('{"', '".join(T.ENTITY_LABELS)}'))"""
_CANON = _VALID + """, surfaced as (select *, trim(regexp_replace(regexp_replace(lower(entity), '[,.;:()\\[\\]{}_-]+', ' ', 'g'), '\\s+', ' ', 'g')) as surface from valid),
labels as (select document_id, surface, count(distinct label) as n from surfaced group by 1, 2),
canon as (select s.*, 'ent_' || replace(s.surface, ' ', '_') || case when l.n > 1 then '_' || lower(label) else '' end as canonical from surfaced s join labels l on s.document_id = l.document_id and s.surface = l.surface where s.surface <> '')"""
_PAIRS = _VALID + """, firsts as (select document_id, chunk_uid, lower(entity) as name, min(coalesce(start_char, 2147483647)) as pos from valid group by 1, 2, 3),
pairs as (select a.document_id, a.chunk_uid, a.name as head, b.name as tail from firsts a join firsts b on a.chunk_uid = b.chunk_uid and a.document_id = b.document_id and (a.pos < b.pos or (a.pos = b.pos and a.name < b.name)))"""
_WEIGHT = "case {0} when 'verified' then 1.0::double when 'explicit' then 1.0 when 'same_sentence' then 0.6 when 'nearby_window' then 0.4 when 'same_chunk' then 0.2 else 0 end"
_EVIDENCE = f"""n0 as (select *, coalesce(nullif(source, ''), 'llm') as src, lower(coalesce(nullif(source, ''), 'llm')) in ('rule-based', 'fallback') as weak from relation_evidence),
n1 as (select *, coalesce(nullif(evidence_type, ''), case when weak then 'same_chunk' else 'explicit' end) as kind, coalesce(nullif(status, ''), case when weak then 'unverified' else 'accepted' end) as st from n0),
evidence as (select document_id, head, relation, tail, src as source, coalesce(nullif(scope, ''), 'local') as scope, case when confidence is null or isnan(confidence) or isinf(confidence) then {_WEIGHT.format('kind')} else greatest(0.0::double, least(1.0::double, confidence)) end as confidence,
  list_sort(list_distinct(list_filter(coalesce(support_chunk_uids, []), lambda x: x is not null and x <> ''))) as support_chunk_uids, kind as evidence_type, coalesce(nullif(verification_state, ''), st) as verification_state, st as status, {_WEIGHT.format('kind')} as resolved_weight from n1)"""
_SURFACE_ID = "'ent_' || replace(trim(regexp_replace(regexp_replace(lower({0}), '[,.;:()\\[\\]{{}}_-]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ', '_')"
_KEY = "'ent_' || replace(lower(trim({0})), ' ', '_')"


def _m(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "mentions")


def _e(spark: SparkSession, root: str) -> DataFrame:
    return E.normal_evidence(read_table(spark, root, "relation_evidence"))


@query(f"with {_VALID} select document_id, entity, label, count(*) as n from valid group by 1, 2, 3")
def f8_valid_entities(spark: SparkSession, root: str) -> DataFrame:
    return E.valid_mentions(_m(spark, root)).groupBy("document_id", "entity", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_VALID} select document_id, chunk_uid, lower(entity) as name, label, min(coalesce(start_char, 2147483647))::integer as pos, count(*) as n from valid group by 1, 2, 3, 4")
def u6_distinct_mentions(spark: SparkSession, root: str) -> DataFrame:
    return E.distinct_mentions(_m(spark, root)).select("document_id", "chunk_uid", "name", "label", "pos", "n")


@query(f"with {_CANON} select document_id, canonical, count(distinct entity) as n_aliases, count(distinct chunk_uid) as n_chunks, count(*) as mention_count from canon group by 1, 2")
def a3_canonical_entities(spark: SparkSession, root: str) -> DataFrame:
    e = E.canonical_entities(_m(spark, root))
    return e.select("document_id", "canonical", F.size("aliases").cast("bigint").alias("n_aliases"), "n_chunks", "mention_count")


_BOTH = "with mentions as (select '*' as document_id, text, label from mentions union all select '*', original_mention, label from entities), " + _VALID.replace("cleaned as (select *,", "cleaned as (select document_id, text, label,") + ", " + _CANON[len(_VALID) + 2:]


@query(f"{_BOTH} select surface, count(distinct label) as n_labels from canon group by 1 having count(distinct label) > 1")
def a4_ambiguous_surfaces(spark: SparkSession, root: str) -> DataFrame:
    """Surfaces that mentions and entities of the whole collection label in several ways."""
    entities = read_table(spark, root, "entities").select(F.col("original_mention").alias("text"), "label")
    m = E.valid_mentions(_m(spark, root).select("text", "label").unionByName(entities)).withColumn("surface", T.canonical_surface(F.col("entity"))).where("surface <> ''")
    return m.groupBy("surface").agg(F.countDistinct("label").alias("n_labels")).where("n_labels > 1")


@query(f"""with {_CANON}, o as (select distinct c.document_id, c.canonical, k.chunk_id, k.chunk_uid from canon c join (select document_id, chunk_uid, min(chunk_id) as chunk_id from chunks group by 1, 2) k on k.document_id = c.document_id and k.chunk_uid = c.chunk_uid)
  select document_id, canonical, chunk_uid, lead(chunk_uid) over (partition by document_id, canonical order by chunk_id, chunk_uid) as next_uid from o qualify next_uid is not null""")
def j7_adjacent_occurrences(spark: SparkSession, root: str) -> DataFrame:
    return E.adjacent_occurrences(_m(spark, root), read_table(spark, root, "chunks"))


@query(f"with {_PAIRS} select document_id, chunk_uid, head, tail from pairs")
def u7_cooccurrences(spark: SparkSession, root: str) -> DataFrame:
    return E.cooccurrences(_m(spark, root))


@query(f"""with {_PAIRS}, t as (select p.document_id, p.chunk_uid, p.head, p.tail, max(case when h.sentence_index = t.sentence_index or (h.sentence_start_char = t.sentence_start_char and h.sentence_end_char = t.sentence_end_char) then 3
    when h.end_char >= h.start_char and t.end_char >= t.start_char and greatest(h.start_char - t.end_char, t.start_char - h.end_char, 0) <= 120 then 2 else 1 end) as tier
  from pairs p join valid h on h.chunk_uid = p.chunk_uid and lower(h.entity) = p.head join valid t on t.chunk_uid = p.chunk_uid and lower(t.entity) = p.tail group by 1, 2, 3, 4),
  k as (select *, case tier when 3 then 'same_sentence' when 2 then 'nearby_window' else 'same_chunk' end as evidence_type from t) select document_id, chunk_uid, head, tail, evidence_type, {_WEIGHT.format('evidence_type')} as weight from k""")
def e3_evidence_tiers(spark: SparkSession, root: str) -> DataFrame:
    return E.evidence_tiers(_m(spark, root))


@query(f"with {_EVIDENCE} select document_id, head, relation, tail, source, scope, confidence, array_to_string(support_chunk_uids, ',') as support, evidence_type, verification_state, status, resolved_weight from evidence")
def e4_normal_evidence(spark: SparkSession, root: str) -> DataFrame:
    return _e(spark, root).withColumn("support", F.array_join("support_chunk_uids", ",")).drop("support_chunk_uids")


@query(f"with {_EVIDENCE} select document_id, head, relation, tail, evidence_type from evidence where status = 'accepted' and evidence_type in ('explicit', 'verified')")
def f9_active_relations(spark: SparkSession, root: str) -> DataFrame:
    return E.active(_e(spark, root)).select("document_id", "head", "relation", "tail", "evidence_type")


@query(f"with {_EVIDENCE} select document_id, lower(head) as head, lower(relation) as relation, lower(tail) as tail, count(*) as n, max(confidence) as confidence from evidence group by 1, 2, 3, 4")
def u5_distinct_relations(spark: SparkSession, root: str) -> DataFrame:
    return E.distinct_relations(_e(spark, root))


@query(f"""with {_EVIDENCE}, k as (select document_id, least({_KEY.format('head')}, {_KEY.format('tail')}) as src, greatest({_KEY.format('head')}, {_KEY.format('tail')}) as dst, resolved_weight, support_chunk_uids from evidence where status = 'accepted' and evidence_type in ('explicit', 'verified')),
  g as (select document_id, src, dst, max(resolved_weight) as weight, count(*) as evidence_count, list_distinct(flatten(list(support_chunk_uids))) as s from k where src <> dst group by 1, 2, 3)
  select document_id, src, dst, weight, evidence_count, len(s)::bigint as n_support from g""")
def a6_coalesced_edges(spark: SparkSession, root: str) -> DataFrame:
    return E.coalesced_edges(E.active(_e(spark, root)))


@query("select status, verification_state, count(*) as n from relation_evidence group by 1, 2")
def a7_status_histogram(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "relation_evidence").groupBy("status", "verification_state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_EVIDENCE}, k as (select distinct document_id, canonical_id, unnest([{_KEY.format('original_mention')}, {_KEY.format('canonical_text')}]) as key from entities), one as (select document_id, key, min(canonical_id) as id from k where key is not null group by 1, 2 having count(distinct canonical_id) = 1)
  select e.document_id, head, relation, tail, h.id as head_id, t.id as tail_id from evidence e join one h on h.document_id = e.document_id and h.key = {_KEY.format('head')} join one t on t.document_id = e.document_id and t.key = {_KEY.format('tail')} where h.id <> t.id""")
def j4_resolved_endpoints(spark: SparkSession, root: str) -> DataFrame:
    return E.resolved_endpoints(_e(spark, root), read_table(spark, root, "entities"))


_SUPPORT = _CANON + ", " + _EVIDENCE + """, ends as (select document_id, unnest([head, tail]) as e, (status = 'accepted' and evidence_type in ('explicit', 'verified')) as active from evidence),
rel as (select document_id, 'ent_' || replace(trim(regexp_replace(regexp_replace(lower(e), '[,.;:()\\[\\]{}_-]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ', '_') as canonical, bool_or(active) as active from ends where e is not null group by 1, 2),
ment as (select document_id, canonical, count(*) as mention_count from canon group by 1, 2),
support as (select m.document_id, m.canonical, mention_count, case when active then 'strongly_supported' when active is not null then 'weakly_supported' else 'mention_only' end as support, (mention_count = 1 and active is null) as isolated_noise_candidate from ment m left join rel r on m.document_id = r.document_id and m.canonical = r.canonical)"""


@query(f"with {_SUPPORT} select * from support")
def a5_entity_support(spark: SparkSession, root: str) -> DataFrame:
    return E.entity_support(_m(spark, root), _e(spark, root))


@query(f"""with {_SUPPORT}, hits as (select distinct document_id, canonical from canon where chunk_uid in (select chunk_uid from chunks where query_protected))
  select s.document_id, s.canonical from support s left join hits h on s.document_id = h.document_id and s.canonical = h.canonical where not isolated_noise_candidate or h.canonical is not null""")
def g20_cleaned_entities(spark: SparkSession, root: str) -> DataFrame:
    hits = read_table(spark, root, "chunks").where("query_protected").select("chunk_uid")
    return E.cleaned_entities(E.entity_support(_m(spark, root), _e(spark, root), hits)).select("document_id", "canonical")


@query(f"with {_CANON} select distinct c.document_id, c.chunk_uid, c.canonical as entity, 1.0::double as weight from canon c join chunks k on c.chunk_uid = k.chunk_uid where not coalesce(k.context_only, false)")
def j3_mention_edges(spark: SparkSession, root: str) -> DataFrame:
    chunks = read_table(spark, root, "chunks").where("not coalesce(context_only, false)").select("chunk_uid")
    m = E.canonical_mentions(_m(spark, root)).join(chunks, "chunk_uid", "left_semi")
    return m.select("document_id", "chunk_uid", F.col("canonical").alias("entity"), F.lit(1.0).alias("weight")).distinct()


@query(f"""with {_CANON}, {_FIXED}, ck as (select distinct chunk_uid from chunks where not coalesce(context_only, false)), e as (
  select distinct c.document_id, c.chunk_uid as src, c.canonical as dst, 'mentions' as edge_type from canon c join ck using (chunk_uid) union all
  select document_id, i, j, 'knn_similarity' from fixed)
  select document_id, edge_type, count(*) as n, count(distinct src) as n_src, count(distinct dst) as n_dst from e group by 1, 2""")
def g1_graph_edges(spark: SparkSession, root: str) -> DataFrame:
    men = j3_mention_edges(spark, root).select("document_id", F.col("chunk_uid").alias("src"), F.col("entity").alias("dst"), F.lit("mentions").alias("edge_type"))
    sem = _fixed(spark, root).select("document_id", F.col("i").alias("src"), F.col("j").alias("dst"), F.lit("knn_similarity").alias("edge_type"))
    return men.unionByName(sem).groupBy("document_id", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


_NEAR = _CANON + ", " + _FIXED + """, ch as (select document_id, chunk_uid, min(chunk_id) as chunk_id, max(hierarchy.section_id) as section, max(hierarchy.paragraph_id) as paragraph, max(hierarchy.parent_chunk_uid) as parent from chunks group by 1, 2),
ids as (select distinct c.document_id, c.canonical as g, ch.chunk_uid, ch.chunk_id from canon c join ch on c.document_id = ch.document_id and c.chunk_uid = ch.chunk_uid),
raw as (select document_id, i as x, j as y, 'semantic_neighbor' as t from fixed
  union all select document_id, chunk_uid, lead(chunk_uid) over (partition by document_id, g order by chunk_id, chunk_uid), 'canonical_identity' from ids
  union all select document_id, chunk_uid, lead(chunk_uid) over (partition by document_id, section order by chunk_id, chunk_uid), 'hierarchy_adjacency' from ch where section <> ''
  union all select document_id, chunk_uid, lead(chunk_uid) over (partition by document_id, paragraph order by chunk_id, chunk_uid), 'hierarchy_adjacency' from ch where paragraph <> ''
  union all select c.document_id, c.chunk_uid, c.parent, 'hierarchy_adjacency' from ch c join ch p on p.document_id = c.document_id and p.chunk_uid = c.parent where c.parent <> ''),
near as (select document_id, least(x, y) as a, greatest(x, y) as b, list_sort(list_distinct(list(t))) as triggers from raw where y is not null and x <> y group by 1, 2, 3)"""


@query(f"with {_NEAR} select document_id, a, b, array_to_string(triggers, ',') as triggers from near")
def g17_neighbourhoods(spark: SparkSession, root: str) -> DataFrame:
    n = E.neighbourhoods(read_table(spark, root, "chunks"), _m(spark, root), _fixed(spark, root))
    return n.withColumn("triggers", F.array_join("triggers", ","))


@query(f"""with {_NEAR}, {_SUPPORT[len(_CANON) + 2:]}, ent as (select document_id, chunk_uid, canonical, min(label) as label from canon group by 1, 2, 3),
  weak as (select distinct e.document_id, e.chunk_uid from ent e join support s on e.document_id = s.document_id and e.canonical = s.canonical where s.support <> 'strongly_supported'),
  p as (select n.document_id, n.a, n.b, n.triggers, l.canonical as l, r.canonical as r from near n join ent l on l.document_id = n.document_id and l.chunk_uid = n.a join ent r on r.document_id = n.document_id and r.chunk_uid = n.b and r.label = l.label and r.canonical <> l.canonical
    where exists (select 1 from weak w where w.document_id = n.document_id and (w.chunk_uid = n.a or w.chunk_uid = n.b)) qualify row_number() over (partition by n.document_id, n.a, n.b order by l.canonical, r.canonical) <= 16)
  select document_id, least(l, r) as head, greatest(l, r) as tail, len(list_distinct(flatten(list([a, b]))))::bigint as n_support, array_to_string(list_sort(list_distinct(flatten(list(triggers)))), ',') as triggers from p group by 1, 2, 3""")
def g19_recovery_candidates(spark: SparkSession, root: str) -> DataFrame:
    m = _m(spark, root)
    near = E.neighbourhoods(read_table(spark, root, "chunks"), m, _fixed(spark, root))
    return E.recovery_candidates(near, m, E.entity_support(m, _e(spark, root)))
