"""The queries of the training-text operators."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .knn import knn, similar_pairs
from .leak import find_leaks
from .neardup import NearDuplicates
from .pii import find_personal, replace_personal
from .scans import Scans
from .split import LIMIT, OVERLAP, split_oversized
from .tokenize import decode_corpus, encode_corpus
from .variants import link_variants, variant_pairs

#: Where the vocabulary file lies on every executor.
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.json"


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    pieces = split_oversized(read_table(spark, root, "chunks"))
    return pieces.where("n_pieces > 1").select("chunk_uid").distinct()


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    return split_oversized(read_table(spark, root, "chunks"))


def p1_rebuilt(spark: SparkSession, root: str) -> DataFrame:
    """What the pieces of each text make when put together without their overlaps, and whether all keep to the limits."""
    chunks = read_table(spark, root, "chunks")
    fits = (F.length("piece") <= LIMIT) & (F.col("overlap") <= OVERLAP)
    own = split_oversized(chunks.groupBy("chunk_uid").agg(F.max("text").alias("text"), F.max("level").alias("level")))
    g = own.groupBy("chunk_uid").agg(F.array_sort(F.collect_list(F.struct("piece_no", F.expr("substring(piece, overlap + 1)").alias("t")))).alias("_p"), F.every(fits).alias("fits"))
    return g.select("chunk_uid", F.sha2(F.array_join(F.transform("_p", lambda x: x["t"]), ""), 256).alias("digest"), "fits")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return Scans(read_table(spark, root, "chunks")).found


def p2_texts(spark: SparkSession, root: str) -> DataFrame:
    return Scans(read_table(spark, root, "chunks")).repaired()


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = NearDuplicates(read_table(spark, root, "chunks")).pairs()
    return pairs.select(F.col("a").alias("chunk_uid_a"), F.col("b").alias("chunk_uid_b"))


def p3_classes(spark: SparkSession, root: str) -> DataFrame:
    """One row per chunk: its class of equal word sets and the number of other classes similar to that."""
    return NearDuplicates(read_table(spark, root, "chunks")).summary()


def usable_points(points: DataFrame) -> DataFrame:
    """Vector rows that a search may return: no control rows, nothing tombstoned."""
    return points.where("vector_point and graph_control_point is null and graph_tombstoned is not true").select("chunk_uid", "embedding")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = similar_pairs(usable_points(read_table(spark, root, "points")), least=0.8)
    return pairs.select(F.col("a").alias("chunk_uid_a"), F.col("b").alias("chunk_uid_b"))


def p5_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The 10 most similar chunks, whatever their cosine, of every chunk whose number is divisible by 50, searched among all rows."""
    points = read_table(spark, root, "points")
    asked = points.where("vector_point and graph_control_point is null and graph_tombstoned is not true and chunk_id % 50 = 0").select("chunk_uid")
    return knn(usable_points(points), queries=asked)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = variant_pairs(link_variants(read_table(spark, root, "entities")))
    return pairs.select(F.col("a").alias("canonical_id_a"), F.col("b").alias("canonical_id_b"))


def p6_links(spark: SparkSession, root: str) -> DataFrame:
    return link_variants(read_table(spark, root, "entities"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_corpus(read_table(spark, root, "documents"), TOKENIZER_FILE)


def p7_decoded(spark: SparkSession, root: str) -> DataFrame:
    """The digest of the text that the ids of each document stand for."""
    ids = encode_corpus(read_table(spark, root, "documents"), TOKENIZER_FILE)
    return decode_corpus(ids, TOKENIZER_FILE).select("doc_id", F.sha2("text", 256).alias("digest"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return find_leaks(read_table(spark, root, "documents"), read_table(spark, root, "eval_items")).select("doc_id", "item_id")


def _key(spark: SparkSession) -> str:
    """The secret of the surrogates: the session's, or one drawn for this call, after which nobody can repeat them."""
    return spark.conf.get("spark.docweave.surrogate.key", None) or secrets.token_hex(32)


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return find_personal(read_table(spark, root, "documents"), _key(spark)).select("doc_id", "kind", "start_char")


def p9_texts(spark: SparkSession, root: str) -> DataFrame:
    return replace_personal(read_table(spark, root, "documents"), _key(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p2_found, p2_texts, p3_found, p3_classes, p5_found, p5_neighbours, p6_found, p6_links, p7_ids, p7_decoded, p8_found, p9_found, p9_texts)}


#: Words as maximal runs of letters and digits, in lower case.
_WORDS = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w))"


def oracle_sql() -> dict[str, str]:
    return {
        # white space as Python's str.strip() knows it
        "p1_found": "select distinct chunk_uid from chunks where length(regexp_replace(regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ''), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+$', '')) > 1200",
        "p1_rebuilt": "select chunk_uid, sha256(regexp_replace(regexp_replace(max(text), '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ''), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+$', '')) as digest, true as fits from chunks where text is not null group by 1",
        "p7_decoded": "select doc_id, sha256(coalesce(text, '')) as digest from documents",
        "p3_found": f"""with t as (select distinct chunk_uid, list_distinct({_WORDS.format("text")}) as w from chunks where text is not null), s as (select chunk_uid, len(w) as n, w from t where len(w) >= 25),
            e as (select chunk_uid, n, unnest(w) as x from s), f as (select x, count(*) as df from e group by 1),
            r as (select e.*, row_number() over (partition by chunk_uid order by df, x) as k from e join f using (x)), p as (select * from r where k <= n - ceil(0.75 * n) + 1),
            c as (select distinct a.chunk_uid as a, b.chunk_uid as b from p a join p b on a.x = b.x and a.chunk_uid < b.chunk_uid and least(a.n, b.n) >= 0.75 * greatest(a.n, b.n))
            select c.a as chunk_uid_a, c.b as chunk_uid_b from c join s x on x.chunk_uid = c.a join s y on y.chunk_uid = c.b where len(list_intersect(x.w, y.w)) >= 0.75 * (x.n + y.n - len(list_intersect(x.w, y.w)))""",
        "p3_classes": f"""with t as (select distinct chunk_uid, list_sort(list_distinct({_WORDS.format("text")})) as w from chunks where text is not null), m as (select chunk_uid, w, min(chunk_uid) over (partition by w) as rep from t where len(w) >= 25),
            s as (select w, rep, len(w) as n, row_number() over (order by rep, w) as id from (select distinct w, rep from m)),
            e as (select id, n, unnest(w) as x from s), f as (select x, count(*) as df from e group by 1),
            r as (select e.*, row_number() over (partition by id order by df, x) as k from e join f using (x)), p as (select * from r where k <= n - ceil(0.75 * n) + 1),
            c as (select distinct a.id as a, b.id as b from p a join p b on a.x = b.x and a.id < b.id and least(a.n, b.n) >= 0.75 * greatest(a.n, b.n)),
            l as (select x.rep as ra, y.rep as rb from c join s x on x.id = c.a join s y on y.id = c.b where len(list_intersect(x.w, y.w)) >= 0.75 * (x.n + y.n - len(list_intersect(x.w, y.w)))),
            g as (select rep, count(*) as n from (select ra as rep from l union all select rb from l) group by 1)
            select distinct m.chunk_uid, m.rep, coalesce(g.n, 0)::bigint as n_links from m left join g using (rep)""",
        "p5_found": """with u as (select chunk_uid, arg_min(embedding, embedding::varchar) as v from points where vector_point and graph_control_point is null and graph_tombstoned is not true and len(embedding) = 64
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1),
            p as (select a.chunk_uid as a, b.chunk_uid as b, round(list_cosine_similarity(a.v, b.v), 9) as c from u a join u b on a.chunk_uid <> b.chunk_uid),
            r as (select *, row_number() over (partition by a order by c desc, b) as k from p) select distinct least(a, b) as chunk_uid_a, greatest(a, b) as chunk_uid_b from r where k <= 10 and c >= 0.8""",
        "p8_found": f"""with i as (select item_id, {_WORDS.format("text")} as w from eval_items where text is not null), n as (select item_id, w, least(len(w), 12) as s from i where len(w) > 0),
            q as (select item_id, s, unnest(list_transform(range(1, len(w) - s + 2), lambda k: array_to_string(w[k:k + s - 1], ' '))) as g from n), z as (select distinct s from n),
            d as (select doc_id, {_WORDS.format("text")} as w from documents where text is not null),
            h as (select doc_id, s, unnest(list_transform(range(1, len(w) - s + 2), lambda k: array_to_string(w[k:k + s - 1], ' '))) as g from d, z where len(w) >= s)
            select distinct doc_id, item_id from h join q using (s, g)""",
    }
