"""Queries of context, evaluation and versions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import evaluate as V
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import lifecycle as L
from ..operators import summarize as S
from ..sources.tables import read_table
from .evidence_queries import _CANON, _EVIDENCE, _SURFACE_ID, j3_mention_edges
from .text_queries import _SENTENCES, WS
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


def _members(spark: SparkSession, root: str) -> DataFrame:
    return C.members_of(read_table(spark, root, "chunks"), G.degrees(_fixed(spark, root)), j13_relation_support(spark, root))


_RELATIONS = _CANON + ", " + _EVIDENCE + f""", verified as (select document_id, least({_SURFACE_ID.format('head')}, {_SURFACE_ID.format('tail')}) as a, greatest({_SURFACE_ID.format('head')}, {_SURFACE_ID.format('tail')}) as b from evidence where evidence_type = 'verified' or verification_state = 'verified'),
vends as (select document_id, unnest([a, b]) as entity, count(*) as n from verified where a <> b group by document_id, a, b), ventity as (select document_id, entity, sum(n)::double as n from vends group by 1, 2),
medges as (select distinct c.document_id, c.chunk_uid, c.canonical as entity from canon c join chunks k on c.chunk_uid = k.chunk_uid where not coalesce(k.context_only, false)),
relsup as (select document_id, chunk_uid, sum(n)::double as support from medges join ventity using (document_id, entity) group by 1, 2)"""


@query(f"with {_RELATIONS} select * from relsup")
def j13_relation_support(spark: SparkSession, root: str) -> DataFrame:
    return C.relation_support(j3_mention_edges(spark, root), E.normal_evidence(read_table(spark, root, "relation_evidence")))


_PARENTS = """c as (select chunk_uid, max(document_id) as doc, max(chunk_id) as number, max(level) as level, max(hierarchy.section_id) as section_id, max(hierarchy.paragraph_id) as paragraph_id, max(hierarchy.parent_chunk_uid) as by_uid, max(hierarchy.parent_id) as by_place, max(hierarchy.parent_chunk_id) as by_number from chunks where chunk_uid is not null group by 1),
  place as (select doc, 'section' as kind, section_id as id, max_by(chunk_uid, {'n': number, 'u': chunk_uid}) as u from c where level = 'section' and section_id is not null group by 1, 3 union all select doc, 'paragraph', paragraph_id, max_by(chunk_uid, {'n': number, 'u': chunk_uid}) from c where level = 'paragraph' and paragraph_id is not null group by 1, 3),
  num as (select doc, number, min(chunk_uid) as u from c where number is not null group by 1, 2),
  found as (select c.chunk_uid, coalesce(u.chunk_uid, p.u, n.u, z.u) as p from c left join c u on u.chunk_uid = c.by_uid left join place p on p.doc = c.doc and p.id = c.by_place and p.kind = case when starts_with(c.by_place, 'paragraph:') then 'paragraph' else 'section' end
    left join num n on n.doc = c.doc and n.number = c.by_number left join num z on z.doc is null and z.number = c.by_number),
  one as (select chunk_uid, p as parent_uid from found where p <> chunk_uid)"""


@query(f"""with {_PARENTS}
  select c.chunk_uid, o.parent_uid, case when t.parent_uid <> c.chunk_uid then t.parent_uid end as grandparent_uid, (case when o.parent_uid is null then 0 when t.parent_uid is null or t.parent_uid = c.chunk_uid then 1 else 2 end)::bigint as depth from c left join one o on o.chunk_uid = c.chunk_uid left join one t on t.chunk_uid = o.parent_uid""")
def j9_parent_context(spark: SparkSession, root: str) -> DataFrame:
    return C.parents(read_table(spark, root, "chunks"))


_MEMBERS = _RELATIONS + ", " + _FIXED + """, d as (select node, count(*) as degree from (select i as node from fixed union all select j from fixed) group by 1),
mem as (select chunk_uid, max({'score': score, 'document_id': document_id, 'text': text, 'section': coalesce(hierarchy.section_id, ''), 'protected': coalesce(query_protected, false)}) as m from chunks where score is not null and not isnan(score) and text is not null group by 1),
members as (select m.document_id as scope, m.section as community, mem.chunk_uid, m.score as query, greatest(m.score, 0) as retrieval, coalesce(degree, 0)::double as graph, coalesce(s.support, 0)::double as relation, m.text as text, m.section as section, m.protected as protected from mem left join d on d.node = mem.chunk_uid left join (select chunk_uid, max(support) as support from relsup group by 1) s on s.chunk_uid = mem.chunk_uid),
g as (select scope, community, count(*) as n, bool_or(protected) as protected, max(greatest(query, 0)) as q, sum(retrieval) as r, avg(graph) as gs, avg(relation) as rs, count(distinct case when text <> '' then lower(text) end)::double as u, count(distinct case when section <> '' then section end)::double as sd from members group by 1, 2),
x as (select scope, community, n, protected, coalesce(q / nullif(max(q) over w, 0), 0) as q, coalesce(r / nullif(max(r) over w, 0), 0) as r, coalesce(gs / nullif(max(gs) over w, 0), 0) as gs, coalesce(rs / nullif(max(rs) over w, 0), 0) as rs, coalesce(u / nullif(max(u) over w, 0), 0) as u, coalesce(sd / nullif(max(sd) over w, 0), 0) as sd from g window w as (partition by scope))"""


@query(f"with {_MEMBERS} select scope, community, n, round(0.25 * q + 0.20 * r + 0.20 * gs + 0.15 * rs + 0.10 * u + 0.10 * sd, 6)::double as importance, (q >= 0.05 or r >= 0.05 or gs >= 0.2 or rs > 0 or protected) as relevant from x")
def a15_community_importance(spark: SparkSession, root: str) -> DataFrame:
    i = C.community_importance(_members(spark, root))
    return i.select("scope", "community", "n", F.round("importance", 6).alias("importance"), "relevant")


@query()
def e7_selected_context(spark: SparkSession, root: str) -> DataFrame:
    return C.select_context(_members(spark, root))


@query()
def g11_selected_paths(spark: SparkSession, root: str) -> DataFrame:
    m = _members(spark, root).select("scope", F.col("chunk_uid").alias("node"), F.col("query").alias("score"))
    e = _fixed(spark, root).select(F.col("document_id").alias("scope"), F.col("i").alias("src"), F.col("j").alias("dst"))
    e = e.unionByName(j3_mention_edges(spark, root).select(F.col("document_id").alias("scope"), F.col("chunk_uid").alias("src"), F.col("entity").alias("dst")))
    return C.graph_paths(m, e)


# a paragraph is the summary of its sentences, the section's title the query
_PAIRS = """para as (select chunk_uid as id, max(text) as summary, max(coalesce(hierarchy.section, '')) as query from chunks where lower(level) = 'paragraph' and text is not null group by 1),
src as (select p.id, c.chunk_uid as source_id, max(c.text) as text, max(c.page_no) as grp from chunks c join para p on p.id = c.hierarchy.parent_chunk_uid where lower(c.level) = 'sentence' and c.text is not null group by 1, 2),
summ as (select * from para where id in (select id from src)), js as (select id, string_agg(text, ' ' order by source_id) as source from src group by 1)"""


def _pairs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    c = read_table(spark, root, "chunks").where("text is not null")
    p = c.where("lower(level) = 'paragraph'").groupBy(F.col("chunk_uid").alias("id")).agg(F.max("text").alias("summary"), F.max(F.coalesce("hierarchy.section", F.lit(""))).alias("query"))
    s = c.where("lower(level) = 'sentence'").groupBy(F.col("hierarchy.parent_chunk_uid").alias("id"), F.col("chunk_uid").alias("source_id")).agg(F.max("text").alias("text"), F.max("page_no").alias("group"))
    s = s.join(p.select("id"), "id", "left_semi")
    return p.join(s.select("id").distinct(), "id", "left_semi"), s


_VOC = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower({0}), '" + WS + "+'), lambda w: regexp_replace(w, '^[.,;:!?()\\[\\]{{}}\"'']+|[.,;:!?()\\[\\]{{}}\"'']+$', '', 'g')), lambda w: w <> ''))"
_VOC = _VOC.replace("\\p{Z}", "\\p{{Z}}")
_TOK = "list_distinct(regexp_extract_all(lower({0}), '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*'))"


@query(f"""with {_PAIRS}, v as (select s.id, {_VOC.format('summary')} as v, {_VOC.format('source')} as sv, {_TOK.format('summary')} as w, {_TOK.format('query')} as q from summ s join js using (id))
  select id, round(case when len(v) > 0 then len(list_intersect(v, sv))::double / len(v) else 0 end, 6) as lexical_overlap, round(case when len(q) > 0 then len(list_intersect(w, q))::double / len(q) end, 6) as query_relevance from v""")
def e13_overlaps(spark: SparkSession, root: str) -> DataFrame:
    m = V.overlap_metrics(*_pairs(spark, root))
    return m.select("id", F.round("lexical_overlap", 6).alias("lexical_overlap"), F.round("query_relevance", 6).alias("query_relevance"))


@query(f"""with {_PAIRS}, s as (select id, unnest({_SENTENCES.format('summary')}) as t, generate_subscripts({_SENTENCES.format('summary')}, 1) - 1 as k from summ), w as (select id, k, {_TOK.format('t')} as w from s),
  x as (select w.id, k, src.source_id, case when len(w) > 0 then len(list_intersect(w, {_TOK.format('src.text')}))::double / len(w) else 0 end as score from w join src on src.id = w.id)
  select id, k::bigint as sentence_index, source_id, round(score, 6) as score from x qualify row_number() over (partition by id, k order by score desc, source_id) = 1""")
def e13_sentence_support(spark: SparkSession, root: str) -> DataFrame:
    return V.sentence_support(*_pairs(spark, root)).withColumn("score", F.round("score", 6))


@query(f"""with {_PAIRS}, s as (select id, unnest({_SENTENCES.format('summary')}) as t, generate_subscripts({_SENTENCES.format('summary')}, 1) as k from summ), w as (select id, k, {_TOK.format('t')} as w from s),
  x as (select a.id, max(case when len(list_distinct(list_concat(a.w, b.w))) > 0 then len(list_intersect(a.w, b.w))::double / len(list_distinct(list_concat(a.w, b.w))) else 0 end) as m from w a join w b on a.id = b.id and a.k < b.k group by 1)
  select s.id, round(1 - coalesce(m, 0), 6)::double as redundancy from summ s left join x using (id)""")
def j15_redundancy(spark: SparkSession, root: str) -> DataFrame:
    return V.redundancy(_pairs(spark, root)[0]).select("id", F.round("redundancy", 6).alias("redundancy"))


@query(f"with {_PAIRS} select id, round(case when count(distinct grp) = 0 then null when count(*) = 1 then 1 else count(distinct grp)::double / count(*) end, 6)::double as diversity from src group by 1")
def a19_evidence_diversity(spark: SparkSession, root: str) -> DataFrame:
    return V.evidence_diversity(_pairs(spark, root)[1]).select("id", F.round("diversity", 6).alias("diversity"))


def _rouge_sql(n: int) -> str:
    grams = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
    if n == 2:
        grams = "list_transform(range(1, len(regexp_extract_all(lower({0}), '[a-z0-9]+'))), lambda i: regexp_extract_all(lower({0}), '[a-z0-9]+')[i] || ' ' || regexp_extract_all(lower({0}), '[a-z0-9]+')[i + 1])"
    return f"""with {_PAIRS}, a as (select id, g, count(*) as n from (select id, unnest({grams.format('summary')}) as g from summ) group by 1, 2), b as (select id, g, count(*) as n from (select s.id, unnest({grams.format('source')}) as g from summ s join js using (id)) group by 1, 2),
      h as (select a.id, sum(least(a.n, b.n)) as hit from a join b on a.id = b.id and a.g = b.g group by 1), na as (select id, sum(n) as n from a group by 1), nb as (select id, sum(n) as n from b group by 1)
      select s.id, round(coalesce(2.0::double * hit / (na.n + nb.n), 0), 6)::double as f from summ s left join h using (id) left join na using (id) left join nb using (id)"""


def _rouge_pairs(spark: SparkSession, root: str) -> DataFrame:
    p, s = _pairs(spark, root)
    return p.join(V.joined_sources(s), "id").select("id", F.col("summary").alias("candidate"), F.col("source").alias("reference"))


@query(_rouge_sql(1))
def e12_rouge_1(spark: SparkSession, root: str) -> DataFrame:
    return V.rouge_n(_rouge_pairs(spark, root), 1).withColumn("f", F.round("f", 6))


@query(_rouge_sql(2))
def e12_rouge_2(spark: SparkSession, root: str) -> DataFrame:
    return V.rouge_n(_rouge_pairs(spark, root), 2).withColumn("f", F.round("f", 6))


@query()
def e12_rouge_l(spark: SparkSession, root: str) -> DataFrame:
    return V.rouge_l(_rouge_pairs(spark, root)).withColumn("f", F.round("f", 6))


@query()
def e15_decisions(spark: SparkSession, root: str) -> DataFrame:
    p, s = _pairs(spark, root)
    return V.decide(V.gate_metrics(p, s)).select("id", "status", "action")


@query(f"""with c as (select distinct document_id, hierarchy.section_id as section, chunk_uid, text from chunks where text is not null and hierarchy.section_id is not null and not coalesce(context_only, false)),
  r as (select *, row_number() over (partition by document_id, section order by length(text) desc, chunk_uid) as k from c)
  select document_id, section, count(*) as n, sha256(string_agg(case when length(text) > 1200 then rtrim(substr(text, 1, 1200)) || ' ...' else text end, chr(10) order by k)) as digest, ceil(sum(least(length(text), 1204)) / 3.0)::bigint <= 3696 as fits from r where k <= 8 group by 1, 2""")
def e8_prompts(spark: SparkSession, root: str) -> DataFrame:
    p = S.section_prompts(read_table(spark, root, "chunks"))
    return p.select("document_id", "section", "n", F.sha2("prompt", 256).alias("digest"), "fits")


@query()
def e9_map_summaries(spark: SparkSession, root: str) -> DataFrame:
    return S.extractive_summaries(*_pairs(spark, root))


@query()
def e11_reduced_summaries(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "chunks").where("lower(level) = 'paragraph' and text is not null")
    return S.reduce_summaries(c.groupBy("document_id", F.col("chunk_uid").alias("id")).agg(F.max("text").alias("summary")))


@query("""with v as (select distinct document_id, version, document_generation, operation_id, attempt_id, state, reserved_at from version_ledger where version is not null)
  select document_id, version, max(version) over (partition by document_id) + 1 as next_version, lag(version) over (partition by document_id order by version, document_generation, operation_id, attempt_id, state, reserved_at) as previous_version from v""")
def w9_versions(spark: SparkSession, root: str) -> DataFrame:
    v = read_table(spark, root, "version_ledger").where("version is not null").select("document_id", "version", "document_generation", "operation_id", "attempt_id", "state", "reserved_at").distinct()
    w = Window.partitionBy("document_id")
    order = w.orderBy(*[F.asc_nulls_last(c) for c in ("version", "document_generation", "operation_id", "attempt_id", "state", "reserved_at")])
    return v.select("document_id", "version", (F.max("version").over(w) + 1).alias("next_version"), F.lag("version").over(order).alias("previous_version"))


@query("""with l as (select document_id, version, max(document_generation) as g from version_ledger where version is not null group by 1, 2)
  select e.document_id, status, case when status = 'tombstoned' then null when status = 'pending' then l.g when status in ('partial', 'unavailable', 'stale') and not coalesce(vector_ready, false) then null else document_generation end as active_generation
  from document_entries e left join l on l.document_id = e.document_id and l.version = e.active_version""")
def l12_active_generations(spark: SparkSession, root: str) -> DataFrame:
    return L.active_generations(read_table(spark, root, "document_entries"), read_table(spark, root, "version_ledger"))


@query("""with t as (select document_id from document_entries where status = 'tombstoned'), c as (select distinct document_id from points where graph_control_point = 'tombstone')
  select coalesce(t.document_id, c.document_id) as document_id, t.document_id is not null as expected, c.document_id is not null as present from t full join c on t.document_id = c.document_id where t.document_id is null or c.document_id is null""")
def n21_tombstone_differences(spark: SparkSession, root: str) -> DataFrame:
    t = read_table(spark, root, "document_entries").where("status = 'tombstoned'").select("document_id").withColumn("expected", F.lit(True))
    c = read_table(spark, root, "points").where("graph_control_point = 'tombstone'").select("document_id").distinct().withColumn("present", F.lit(True))
    d = t.join(c, "document_id", "full").select("document_id", F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("present", F.lit(False)).alias("present"))
    return d.where("not (expected and present)")


@query("""select p.document_id, bool_and(p.document_generation = e.document_generation and p.document_attempt_id = e.document_attempt_id and not coalesce(p.graph_tombstoned, false)) as owned from points p join document_entries e using (document_id) where p.graph_control_point is null group by 1""")
def n20_owned_documents(spark: SparkSession, root: str) -> DataFrame:
    e = read_table(spark, root, "document_entries").select("document_id", F.col("document_generation").alias("_g"), F.col("document_attempt_id").alias("_a"))
    p = read_table(spark, root, "points").where("graph_control_point is null").join(e, "document_id")
    return p.groupBy("document_id").agg(F.every((F.col("document_generation") == F.col("_g")) & (F.col("document_attempt_id") == F.col("_a")) & ~F.coalesce("graph_tombstoned", F.lit(False))).alias("owned"))


@query("select user_id, date_trunc('day', ts) as day, event_type, count(*) as n, round(sum(value), 4)::double as total from events group by 1, 2, 3")
def event_rollup(spark: SparkSession, root: str) -> DataFrame:
    e = read_table(spark, root, "events")
    return e.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""select n_name as nation, l_returnflag as flag, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2)::double as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2""")
def revenue_rollup(spark: SparkSession, root: str) -> DataFrame:
    t = lambda n: read_table(spark, root, n)
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy(F.col("n_name").alias("nation"), F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
