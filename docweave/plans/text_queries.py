"""Queries of chunking and text functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..sources.tables import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: White space of Unicode, which this SQL's regular expressions know only in part.
WS = r"[\s\x0b\x85\p{Z}]"
_PARTS = f"""parts as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
kept as (select doc_id, pos, regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') as line from parts where regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') <> '')"""
_WORDS = "len(list_filter(regexp_split_to_array({0}, '" + WS.replace("{", "{{").replace("}", "}}") + "+'), lambda w: w <> ''))::bigint"
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])@+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^@+|@+$', '', 'g')), lambda s: s <> '')".replace("@", WS.replace("{", "{{").replace("}", "}}"))


@query(f"""with {_PARTS}, n as (select *, {_WORDS.format('line')} as n_words, len({_SENTENCES.format('line')}) as n_sentences from kept)
  select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::bigint as chunk_id,
    case when n_sentences > 1 then 'paragraph' when n_words <= 30 and regexp_matches(line, '[.!?]$') then 'sentence' else 'paragraph' end as level, n_words from n""")
def s3_line_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunking.line_chunks(read_table(spark, root, "documents")).select("doc_id", "chunk_id", "level", "n_words")


@query(f"""with {_PARTS}, n as (select *, {_WORDS.format('line')} as n_words, {_SENTENCES.format('line')} as ss from kept),
  l as (select *, case when starts_with(line, '# ') then 'section' when starts_with(line, '|') then 'table' when regexp_matches(line, '^(Figure|Fig\\.) [0-9]') then 'figure' when len(ss) > 1 then 'paragraph' when n_words <= 30 and regexp_matches(line, '[.!?]$') then 'sentence' else 'paragraph' end as lv from n),
  k as (select *, case lv when 'paragraph' then 1 + len(list_filter(ss, lambda s: s <> line)) when 'sentence' then 2 else 1 end as n_pieces from l),
  r as (select *, sum(n_pieces) over w - n_pieces as start, sum((lv = 'section')::int) over w as sec, sum((lv in ('paragraph', 'sentence'))::int) over w as par, last_value(case when lv = 'section' then line end ignore nulls) over w as section from k window w as (partition by doc_id order by pos rows between unbounded preceding and current row)),
  q as (select *, last_value(case when lv = 'section' then start end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row) as at_, case when sec > 0 then 'section:' || sec end as section_id, case when lv in ('paragraph', 'sentence') then 'paragraph:' || par end as paragraph_id from r),
  f as (select *, list_filter(list_transform(ss, lambda s, i: {{'t': s, 'i': i}}), lambda x: x.t <> line) as sub from q),
  c as (select *, start as chunk_id, line as text, case when lv = 'sentence' then 'paragraph' else lv end as level, lv = 'sentence' as context_only, null::int as sentence_index from f
    union all select *, start + 1, line, 'sentence', false, 1 from f where lv = 'sentence' union all select * exclude (u, g), start + g, u.t, 'sentence', false, u.i::int from (select *, unnest(sub) as u, generate_subscripts(sub, 1) as g from f where lv = 'paragraph' and len(sub) > 0))
  select doc_id, chunk_id::bigint as chunk_id, sha256(text) as digest, level, context_only, section_id, paragraph_id, sentence_index, case when level = 'sentence' then paragraph_id when level <> 'section' then section_id end as parent_id, (case when level = 'sentence' then start when level <> 'section' then at_ end)::bigint as parent_chunk_id,
    concat_ws('/', section_id, paragraph_id, case when level = 'sentence' then 'sentence:' || sentence_index when level in ('table', 'figure') then level || ':' || chunk_id end) as path from c""")
def s3_structural_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunking.structural_chunks(read_table(spark, root, "documents")).withColumn("digest", F.sha2("text", 256)).drop("text", "section")


@query(f"""with p as (select doc_id, unnest(string_split(text, chr(10) || chr(10))) as part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) as pos from documents where text is not null),
  k as (select doc_id, pos, regexp_replace(part, '^{WS}+|{WS}+$', '', 'g') as text from p)
  select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::bigint as chunk_id, text from k where text <> ''""")
def s4_blank_line_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunking.blank_line_chunks(read_table(spark, root, "documents"))


@query(f"""with {_PARTS}, m as (select *, regexp_matches(line, '^# ') as is_section from kept)
  select doc_id, pos::bigint as pos, sum(case when is_section then 1 else 0 end) over w::bigint as section_index, sum(case when is_section then 0 else 1 end) over w::bigint as paragraph_index,
    last_value(case when is_section then line end ignore nulls) over w as section from m window w as (partition by doc_id order by pos rows between unbounded preceding and current row)""")
def w5_running_section(spark: SparkSession, root: str) -> DataFrame:
    return chunking.running_sections(read_table(spark, root, "documents"))


@query(f"""with s as (select doc_id, {_SENTENCES.format('text')} as s from documents where text is not null),
  e as (select doc_id, unnest(s) as sentence, generate_subscripts(s, 1) as i from s)
  select doc_id, i::bigint as sentence_index, {_WORDS.format('sentence')} as n_words from e""")
def x1_sentences(spark: SparkSession, root: str) -> DataFrame:
    d = read_table(spark, root, "documents")
    return d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("sentence_index"), T.word_count(F.col("sentence")).alias("n_words"))


@query(f"""select chunk_uid, {_WORDS.format('text')} as word_count, case when context_only then 'context_only' else 'tiny_sentence' end as reason, count(*) as n from chunks
  where text is not null and (coalesce(context_only, false) or (lower(level) = 'sentence' and {_WORDS.format('text')} < 8)) group by all""")
def f11_tiny_sentences(spark: SparkSession, root: str) -> DataFrame:
    return chunking.rejected_chunks(read_table(spark, root, "chunks")).groupBy("chunk_uid", "word_count", "reason").count().withColumnRenamed("count", "n")


@query("""select chunk_uid, regexp_replace(regexp_replace(trim(text), '\\s+', ' ', 'g'), '^[ ,.;:()\\[\\]{}]+|[ ,.;:()\\[\\]{}]+$', '', 'g') as entity, count(*) as n from mentions where text is not null group by all""")
def x2_clean_entities(spark: SparkSession, root: str) -> DataFrame:
    m = read_table(spark, root, "mentions").where("text is not null")
    return m.groupBy("chunk_uid", T.clean_entity(F.col("text")).alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@query("""select text, trim(regexp_replace(regexp_replace(lower(text), '[,.;:()\\[\\]{}_-]+', ' ', 'g'), '\\s+', ' ', 'g')) as surface, 'ent_' || replace(lower(trim(text)), ' ', '_') as endpoint, count(*) as n from mentions where text is not null group by all""")
def x3_surfaces(spark: SparkSession, root: str) -> DataFrame:
    m = read_table(spark, root, "mentions").where("text is not null")
    return m.groupBy("text", T.canonical_surface(F.col("text")).alias("surface"), T.endpoint_key(F.col("text")).alias("endpoint")).agg(F.count(F.lit(1)).alias("n"))


@query("""select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')))::bigint as n_tokens from documents where text is not null""")
def x6_metric_tokens(spark: SparkSession, root: str) -> DataFrame:
    d = read_table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", F.size(T.metric_tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query("""select doc_id, len(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '[\\s\\x0b\\x85\\p{Z}]+'), lambda w: regexp_replace(w, '^[.,;:!?()\\[\\]{}"'']+|[.,;:!?()\\[\\]{}"'']+$', '', 'g')), lambda w: w <> '')))::bigint as n_words
  from documents where text is not null""")
def x7_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    d = read_table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", F.size(T.vocabulary(F.col("text"))).cast("bigint").alias("n_words"))


# SQL's regular expressions know no word boundary beside accented letters, so there is none for this
@query()
def x8_named_like(spark: SparkSession, root: str) -> DataFrame:
    d = read_table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", F.explode(T.named_like(F.col("text"))).alias("name"))


@query()
def x9_numbers_and_dates(spark: SparkSession, root: str) -> DataFrame:
    d = read_table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", F.explode(T.numbers_and_dates(F.col("text"))).alias("value"))


@query("""select chunk_uid, substr(text, 1, 120) as preview, case when length(text) > 1200 then rtrim(substr(text, 1, 1200)) || ' ...' else text end as evidence, count(*) as n from chunks group by all""")
def x12_truncated(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "chunks")
    return c.groupBy("chunk_uid", T.truncate(F.col("text"), 120).alias("preview"), T.truncate(F.col("text"), 1200, " ...").alias("evidence")).agg(F.count(F.lit(1)).alias("n"))


@query("""select doc_id, ceil(n_chars / 3)::bigint as est_tokens, case when ceil(n_chars / 3) > 4096 - 400 then 'blocked' else 'ok' end as status from documents where n_chars is not null""")
def x13_token_gate(spark: SparkSession, root: str) -> DataFrame:
    d = read_table(spark, root, "documents").where("text is not null")
    est = T.token_estimate(F.col("text"))
    return d.select("doc_id", est.alias("est_tokens"), F.when(est > 4096 - 400, "blocked").otherwise("ok").alias("status"))


@query("select doc_id, sha256(text) as digest from documents where text is not null")
def x18_digests(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"""with c as (select distinct chunk_uid, sha1(unhex('{T.URL_NAMESPACE.replace("-", "")}') || encode('{T.POINT_PREFIX}' || chunk_uid)) as h from chunks)
  select chunk_uid, case when chunk_uid is not null then substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1)::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) end as point_id from c""")
def x18_point_ids(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "chunks").select("chunk_uid").distinct()
    return c.select("chunk_uid", T.uuid5(T.URL_NAMESPACE, F.concat(F.lit(T.POINT_PREFIX), "chunk_uid")).alias("point_id"))


@query("select document_id, url_encode(document_id || '/v 1~*') as key, count(*) as n from chunks group by all")
def x19_key_components(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "chunks")
    return c.groupBy("document_id", T.key_component(F.concat("document_id", F.lit("/v 1~*"))).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, regexp_replace(text, '(?i)\\b(api[_-]?key|token|secret|password)(\\s*[:=]\\s*)\\S+', '\\1\\2[redacted]', 'g') as text from documents where text is not null")
def x20_redacted(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents").where("text is not null").select("doc_id", T.redact(F.col("text")).alias("text"))


@query("select document_id, regexp_replace(lower(regexp_replace(document_id || '.v1 (final)', '[^\\p{L}\\p{N}-]', '_', 'g')), '^_+|_+$', '', 'g') as name, count(*) as n from chunks group by all")
def s22_collection_names(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "chunks")
    return c.groupBy("document_id", T.collection_name(F.concat("document_id", F.lit(".v1 (final)"))).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("""select chunk_uid, array_to_string(list_filter(hierarchy.path, lambda x: x is not null), '>') as path_id, coalesce(nullif(hierarchy.section_id, ''), nullif(hierarchy.section, ''), '') as section_key, count(*) as n from chunks group by all""")
def x24_paths(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "chunks")
    path = F.array_join(F.array_compact("hierarchy.path"), ">")
    return c.groupBy("chunk_uid", path.alias("path_id"), T.section_key(F.col("hierarchy.section_id"), F.col("hierarchy.section")).alias("section_key")).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '<[^<>]+>', '', 'g'), '(?m)^#{1,6}\\s+', '', 'g'), '\\*\\*|`', '', 'g') as text from documents where text is not null")
def s2_plain_text(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents").where("text is not null").select("doc_id", T.plain_text(F.col("text")).alias("text"))


@query("""with f as (select document_id, page_no, min(image_url) as image_url from chunks where image_url is not null and page_no is not null group by 1, 2),
  c as (select distinct chunk_uid, document_id, page_no from chunks) select c.chunk_uid, c.page_no, f.image_url from c left join f on c.document_id = f.document_id and c.page_no = f.page_no""")
def s19_page_images(spark: SparkSession, root: str) -> DataFrame:
    return chunking.attach_page_images(read_table(spark, root, "chunks"))


@query("""with c as (select document_id, chunk_id, chunk_uid, min(lower(level)) as level from chunks group by all)
  select document_id, chunk_uid, row_number() over (partition by document_id order by chunk_id, chunk_uid)::bigint as ord, lead(chunk_uid) over (partition by document_id order by chunk_id, chunk_uid) as next_uid from c""")
def w6_adjacent_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunking.document_order(read_table(spark, root, "chunks"))
