"""Queries of records: scans, projections, composition, references and proofs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..operators import evidence as E
from ..operators import lifecycle as L
from ..operators import models
from ..operators import retrieval as R
from ..operators.vectors import usable_points, valid_vector
from ..sources.artifacts import graph_edges, graph_rows
from ..sources.tables import read_table
from .evidence_queries import _CANON, _SUPPORT
from .vector_queries import _FIXED, _USABLE, _fixed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select document_id, graph_control_point, count(*) as n, count(distinct point_id) as n_ids, max(len(embedding)) as dim from points group by 1, 2")
def s6_scan(spark: SparkSession, root: str) -> DataFrame:
    p = read_table(spark, root, "points")
    return p.groupBy("document_id", "graph_control_point").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("point_id").alias("n_ids"), F.max(F.when(F.col("embedding").isNotNull(), F.size("embedding"))).cast("bigint").alias("dim"))


@query("""select document_id, chunk_uid, chunk_id, text, page_no, count(*) as copies from points where coalesce(document_id, '') <> '' and vector_point and graph_control_point is null group by all""")
def s7_document_scan(spark: SparkSession, root: str) -> DataFrame:
    p = read_table(spark, root, "points").where("coalesce(document_id, '') <> '' and vector_point and graph_control_point is null")
    return p.groupBy("document_id", "chunk_uid", "chunk_id", "text", "page_no").agg(F.count(F.lit(1)).alias("copies"))


@query(f"with {_USABLE} select document_id, count(*) as n, count(distinct chunk_uid) as n_chunks from usable where coalesce(point_id, '') <> '' group by 1")
def s8_backfill_scan(spark: SparkSession, root: str) -> DataFrame:
    p = read_table(spark, root, "points").where("vector_point and graph_control_point is null and graph_tombstoned is not true and coalesce(point_id, '') <> ''").where(valid_vector(F.col("embedding"), 64))
    return p.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_uid").alias("n_chunks"))


@query("select document_id, layout.page_no as page_no, min(image_url) as image_url from chunks where image_url is not null and layout.page_no is not null group by 1, 2")
def s18_page_image_map(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "chunks").where("image_url is not null and layout.page_no is not null")
    return c.groupBy("document_id", F.col("layout.page_no").alias("page_no")).agg(F.min("image_url").alias("image_url"))


@query(f"with {_FIXED} select document_id, i, j, sim from fixed")
def s16_graph_round_trip(spark: SparkSession, root: str) -> DataFrame:
    return graph_edges(graph_rows(_fixed(spark, root)))


@query("""select document_id || ':chunk:' || chunk_id as chunk_uid, document_id, chunk_id, document_generation, coalesce(level, 'paragraph') as level, coalesce(page_no, 0) as page_no, sha256('ingest-point:' || document_id || ':' || document_generation || ':' || coalesce(document_attempt_id, '') || ':' || chunk_uid) as attempt_key from points where vector_point and chunk_uid is not null and document_generation is not null""")
def f2_write_projection(spark: SparkSession, root: str) -> DataFrame:
    p = read_table(spark, root, "points").where("vector_point and chunk_uid is not null and document_generation is not null")
    key = F.concat(F.lit("ingest-point:"), "document_id", F.lit(":"), F.col("document_generation").cast("string"), F.lit(":"), F.coalesce("document_attempt_id", F.lit("")), F.lit(":"), "chunk_uid")
    return p.select(F.concat("document_id", F.lit(":chunk:"), F.col("chunk_id").cast("string")).alias("chunk_uid"), "document_id", "chunk_id", "document_generation", F.coalesce("level", F.lit("paragraph")).alias("level"), F.coalesce("page_no", F.lit(0)).alias("page_no"), F.sha2(key, 256).alias("attempt_key"))


@query("""select p.point_id from points p where coalesce(graph_point, true) and graph_control_point is null and not coalesce(graph_tombstoned, false) and exists (select 1 from document_entries e where e.document_id = p.document_id and e.document_generation = p.document_generation and e.document_attempt_id = p.document_attempt_id and e.status = 'available')""")
def f5_active_graph_points(spark: SparkSession, root: str) -> DataFrame:
    # a flag that was never set counts as set
    points = read_table(spark, root, "points").where("graph_control_point is null").withColumn("graph_point", F.coalesce("graph_point", F.lit(True)))
    return R.active_graph(points, read_table(spark, root, "document_entries").where("status = 'available'")).select("point_id")


@query("select chunk_uid, max(score) as score from chunks where score is not null and not isnan(score) and score >= 0.5 and not coalesce(context_only, false) group by 1")
def f12_minimum_score(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "chunks").where("score is not null and not isnan(score) and score >= 0.5 and not coalesce(context_only, false)")
    return c.groupBy("chunk_uid").agg(F.max("score").alias("score"))


@query("select m.chunk_uid, m.canonical_id, count(*) as n, bool_or(h.chunk_uid is not null) as protected from mentions m left join (select distinct chunk_uid from chunks where query_protected) h on m.chunk_uid = h.chunk_uid group by 1, 2")
def f16_protected_mentions(spark: SparkSession, root: str) -> DataFrame:
    hits = read_table(spark, root, "chunks").where("query_protected").select("chunk_uid").distinct().withColumn("_h", F.lit(True))
    m = read_table(spark, root, "mentions").join(hits, "chunk_uid", "left")
    return m.groupBy("chunk_uid", "canonical_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("_h", F.lit(False))).alias("protected"))


@query(f"with {_CANON} select distinct document_id || '::' || canonical as node, chunk_uid from canon")
def j12_composed_graph(spark: SparkSession, root: str) -> DataFrame:
    m = E.canonical_mentions(read_table(spark, root, "mentions"))
    return m.select(F.concat("document_id", F.lit("::"), "canonical").alias("node"), "chunk_uid").distinct()


@query("""with a as (select lower(trim(head)) as h, lower(trim(tail)) as t, 1 as side from relation_evidence where source = 'llm' union all select lower(trim(head)), lower(trim(tail)), 2 from relation_evidence where source is distinct from 'llm')
  select h as head, t as tail, max(side)::integer as side, count(*) as n from a group by 1, 2""")
def u2_composed_relations(spark: SparkSession, root: str) -> DataFrame:
    e = read_table(spark, root, "relation_evidence").select(F.lower(F.trim("head")).alias("head"), F.lower(F.trim("tail")).alias("tail"), "source")
    mine, other = F.col("source") == "llm", ~F.col("source").eqNullSafe("llm")
    both = e.where(mine).withColumn("side", F.lit(1)).unionByName(e.where(other).withColumn("side", F.lit(2)))
    return both.groupBy("head", "tail").agg(F.max("side").alias("side"), F.count(F.lit(1)).alias("n"))


@query("""select chunk_uid, max(length(text) + length(coalesce(hierarchy.section, '')) + 4 * len(coalesce(hierarchy.path, []))) as cost from chunks where text is not null group by 1""")
def x14_character_cost(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "chunks").where("text is not null")
    cost = F.length("text") + F.length(F.coalesce("hierarchy.section", F.lit(""))) + 4 * F.coalesce(F.when(F.col("hierarchy.path").isNotNull(), F.size("hierarchy.path")), F.lit(0))
    return c.groupBy("chunk_uid").agg(F.max(cost).cast("bigint").alias("cost"))


@query(r"""select doc_id, len(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\x{24B6}-\x{24E9}'']+')))::int as n_tokens from documents where text is not null""")
def x5_allocator_tokens(spark: SparkSession, root: str) -> DataFrame:
    d = read_table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", F.size(T.allocator_tokens(F.col("text"))).alias("n_tokens"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null), j as (select doc_id, line from l where regexp_matches(line, '^\{"status".*\}\s*$') and json_valid(line))
  select doc_id, json_extract_string(line, '$.status') as status, json_extract_string(line, '$.reason') as reason, json_extract_string(line, '$.retry')::integer as retry from j""")
def x21_parsed_reports(spark: SparkSession, root: str) -> DataFrame:
    lines = read_table(spark, root, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r'^\{"status".*\}\s*$'))
    parsed = lines.select("doc_id", F.from_json("line", "status string, reason string, retry int, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    return parsed.where("j._corrupt_record is null").select("doc_id", "j.status", "j.reason", "j.retry")


@query("""with c as (select distinct document_id, chunk_uid, chunk_id, hierarchy.sentence_index as s from chunks) select document_id, chunk_uid, row_number() over (partition by document_id order by chunk_id nulls last, coalesce(s, 0), chunk_uid)::bigint as ord from c""")
def x22_document_order(spark: SparkSession, root: str) -> DataFrame:
    return chunking.document_order(read_table(spark, root, "chunks")).drop("next_uid")


@query("""with n as (select max(reserved_at) as now from version_ledger) select document_id, version, operation_id, count(*) as n from version_ledger, n where state = 'reserved' and date_diff('second', reserved_at, now) > 900 group by 1, 2, 3""")
def x23_expired_reservations(spark: SparkSession, root: str) -> DataFrame:
    v = read_table(spark, root, "version_ledger")
    now = v.agg(F.max("reserved_at").alias("now"))
    rows = v.where("state = 'reserved'").withColumn("now", F.lit(now.first()[0]))
    late = rows.where(F.timestamp_diff("SECOND", F.col("reserved_at").cast("timestamp"), F.col("now").cast("timestamp")) > 900)
    return late.groupBy("document_id", "version", "operation_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_SUPPORT} select document_id, canonical from support where support <> 'strongly_supported'")
def g18_weak_seeds(spark: SparkSession, root: str) -> DataFrame:
    e = E.normal_evidence(read_table(spark, root, "relation_evidence"))
    return E.entity_support(read_table(spark, root, "mentions"), e).where("support <> 'strongly_supported'").select("document_id", "canonical")


@query(f"with {_USABLE} select document_id, chunk_uid as node, 0::bigint as community from vec")
def g21_vector_only_graph(spark: SparkSession, root: str) -> DataFrame:
    return usable_points(read_table(spark, root, "points")).select("document_id", F.col("chunk_uid").alias("node"), F.lit(0).cast("bigint").alias("community"))


@query(f"""with {_FIXED}, e as (select canonical_id, document_id, unnest(chunk_uids) as uid from entities), d as (select node, count(*) as degree from (select i as node from fixed union all select j from fixed) group by 1)
  select canonical_id, count(distinct uid) as n_chunks, coalesce(sum(degree), 0)::bigint as graph_degree from (select distinct canonical_id, uid from e where uid is not null) x left join d on d.node = x.uid group by 1""")
def n2_entity_degrees(spark: SparkSession, root: str) -> DataFrame:
    from ..operators.graph import degrees

    x = read_table(spark, root, "entities").select("canonical_id", F.explode("chunk_uids").alias("node")).where("node is not null").distinct()
    d = degrees(_fixed(spark, root)).select("node", "degree")
    return x.join(d, "node", "left").groupBy("canonical_id").agg(F.countDistinct("node").alias("n_chunks"), F.coalesce(F.sum("degree"), F.lit(0)).cast("bigint").alias("graph_degree"))


@query("""with r as (select distinct m.document_id, m.chunk_id, c.chunk_uid from mentions m join (select distinct document_id, chunk_id, chunk_uid from chunks) c on m.chunk_id = c.chunk_id and m.document_id = c.document_id),
  u as (select document_id, chunk_id, min(chunk_uid) as chunk_uid from r group by 1, 2 having count(*) = 1) select * from u""")
def n3_chunk_references(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "chunks").select("document_id", "chunk_id", "chunk_uid").distinct()
    m = read_table(spark, root, "mentions").select("document_id", "chunk_id").distinct()
    return m.join(c, ["document_id", "chunk_id"]).groupBy("document_id", "chunk_id").agg(F.min("chunk_uid").alias("chunk_uid"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


@query("""with d as (select document_id, count(*) as n, sha256(string_agg(point_id, ',' order by point_id)) as digest from points where vector_point group by 1), v as (select document_id, count(*) as n, sha256(string_agg(point_id, ',' order by point_id)) as digest from points where vector_point and graph_tombstoned is not true group by 1)
  select d.document_id, coalesce(d.n = v.n and d.digest = v.digest, false) as ok from d left join v using (document_id)""")
def l9_control_proofs(spark: SparkSession, root: str) -> DataFrame:
    p = read_table(spark, root, "points").where("vector_point")
    return L.control_proof(p.where("graph_tombstoned is not true"), R.point_set_digest(p))


# what comes in is a new generation of the documents that are not available
@query("""with n as (select point_id, document_id, document_generation + 1 as document_generation from points where document_id in (select document_id from document_entries where status <> 'available'))
  select 'append' as mode, count(*) as n from points union all
  select 'replace-document', (select count(*) from points p where not exists (select 1 from n where n.document_id = p.document_id)) + (select count(*) from n) union all select 'replace-collection', (select count(*) from n)""")
def l1_ingest_modes(spark: SparkSession, root: str) -> DataFrame:
    old = read_table(spark, root, "points").select("point_id", "document_id", "document_generation")
    due = read_table(spark, root, "document_entries").where("status <> 'available'").select("document_id")
    new = old.join(due, "document_id", "left_semi").select("point_id", "document_id", (F.col("document_generation") + 1).alias("document_generation"))
    parts = [L.ingest(old, new, m).groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("mode"), "n") for m in L.MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""with e as (select document_id, document_attempt_id, document_generation + (pending_version is not null)::int as g from document_entries)
  select p.point_id, e.g as document_generation, e.document_attempt_id, p.point_id as source_point_id from points p join e on p.document_id = e.document_id where p.vector_point and p.document_generation is distinct from e.g""")
def l10_backfilled(spark: SparkSession, root: str) -> DataFrame:
    b = L.backfilled(read_table(spark, root, "points"), L.once_published(read_table(spark, root, "document_entries")))
    return b.select("point_id", "document_generation", "document_attempt_id", "source_point_id")


@query()
def v1_hashed_embeddings(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "chunks").groupBy("chunk_uid").agg(F.min("text").alias("text"))
    return models.embed(c, "chunk_uid").select("chunk_uid", F.round(F.element_at("embedding", 1), 6).alias("first"))
